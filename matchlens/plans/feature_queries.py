"""Season and per-game features."""

from pyspark.sql import functions as F

from matchlens.operators import features
from matchlens.plans.views import check_sql
from matchlens.sources import tables

QUERIES, CHECKS = {}, {}

SRS_ROUNDS = 5
FORM_GAMES = 5


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def history(spark, sf_dir):
    return features.team_games(tables.games(spark, sf_dir))


def box(spark, sf_dir, sport, measures):
    games = tables.games(spark, sf_dir).filter(F.col("sport") == sport)
    return features.team_box(tables.box_lines(spark, sf_dir), games, measures)


def rolling_form(spark, sf_dir):
    form = features.rolling_form(history(spark, sf_dir), FORM_GAMES)
    form = form.select("game_id", "team", "form_games", "form_for", "form_against", "form_margin")
    return rounded(form, "form_for", "form_against", "form_margin")


QUERIES["rolling_form"] = rolling_form
CHECKS["rolling_form"] = check_sql(f"""
SELECT game_id, team, count(*) OVER w AS form_games, round(avg(pf) OVER w, 6) AS form_for,
       round(avg(pa) OVER w, 6) AS form_against, round(avg(margin) OVER w, 6) AS form_margin
FROM team_games WINDOW w AS (PARTITION BY sport, team ORDER BY start_ts, game_id
                             ROWS BETWEEN {FORM_GAMES} PRECEDING AND 1 PRECEDING)""")


def rest_days(spark, sf_dir):
    rest = features.rest_days(history(spark, sf_dir))
    return rest.select("game_id", "team", "rest_days", "back_to_back", "recent_games")


QUERIES["rest_days"] = rest_days
CHECKS["rest_days"] = check_sql("""
SELECT game_id, team, rest_days, coalesce(rest_days <= 1, FALSE) AS back_to_back, recent_games FROM (
  SELECT game_id, team, CAST(date_diff('day', lag(game_date) OVER w, game_date) AS INTEGER) AS rest_days,
         count(*) OVER (PARTITION BY sport, team ORDER BY game_date
            RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS recent_games
  FROM team_games WINDOW w AS (PARTITION BY sport, team ORDER BY start_ts, game_id))""")


def h2h(spark, sf_dir):
    met = features.head_to_head(tables.games(spark, sf_dir))
    return rounded(met.select("game_id", "meetings", "home_wins", "home_margin_avg"), "home_margin_avg")


QUERIES["h2h"] = h2h
CHECKS["h2h"] = check_sql("""
SELECT game_id, meetings, home_wins, round(ms / meetings, 6) AS home_margin_avg FROM (
  SELECT game_id, count(*) OVER w AS meetings,
         coalesce(CAST(CASE WHEN home_team = ta THEN sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) OVER w
              ELSE sum(CASE WHEN m < 0 THEN 1 ELSE 0 END) OVER w END AS BIGINT), 0) AS home_wins,
         CASE WHEN home_team = ta THEN 1 ELSE -1 END * CAST(sum(m) OVER w AS DOUBLE) AS ms
  FROM (SELECT *, least(home_team, away_team) AS ta, greatest(home_team, away_team) AS tb,
               CASE WHEN home_team < away_team THEN home_final - away_final ELSE away_final - home_final END AS m
        FROM games WHERE home_final IS NOT NULL)
  WINDOW w AS (PARTITION BY sport, ta, tb ORDER BY start_ts, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")


def streak(spark, sf_dir):
    return features.current_streak(history(spark, sf_dir))


QUERIES["streak"] = streak
CHECKS["streak"] = check_sql("""
SELECT sport, season, team, result || n AS current_form FROM (
  SELECT sport, season, team, result, grp, count(*) AS n, max(struct_pack(a := start_ts, b := game_id)) AS last,
         row_number() OVER (PARTITION BY sport, season, team ORDER BY max(rn) DESC) AS place
  FROM (SELECT *, rn - row_number() OVER (PARTITION BY sport, season, team, result ORDER BY start_ts, game_id) AS grp
        FROM (SELECT *, row_number() OVER (PARTITION BY sport, season, team ORDER BY start_ts, game_id) AS rn FROM team_games))
  GROUP BY sport, season, team, result, grp) WHERE place = 1""")


def team_season(spark, sf_dir):
    season = features.team_season(history(spark, sf_dir)).drop("home_away_split")
    return rounded(season, "wins_all_percentage", "for_avg", "against_avg", "differential_avg")


QUERIES["team_season"] = team_season
_TS = """
SELECT sport, season, team, count(*) AS games_played, count(*) FILTER (result = 'W') AS wins,
       count(*) FILTER (result = 'W') / count(*) AS win_share,
       CAST(sum(pf) AS BIGINT) AS points_for, CAST(sum(pa) AS BIGINT) AS points_against,
       avg(pf) AS for_avg, avg(pa) AS against_avg, CAST(sum(margin) AS BIGINT) AS differential,
       avg(margin) AS differential_avg,
       avg(margin) FILTER (is_home) - avg(margin) FILTER (NOT is_home) AS split
FROM team_games GROUP BY sport, season, team"""
CHECKS["team_season"] = check_sql("""
SELECT sport, season, team, games_played, wins, round(win_share, 6) AS wins_all_percentage, points_for, points_against,
       round(for_avg, 6) AS for_avg, round(against_avg, 6) AS against_avg, differential,
       round(differential_avg, 6) AS differential_avg FROM ts""", ts=_TS)  # fmt: skip


def home_away_split(spark, sf_dir):
    season = features.team_season(history(spark, sf_dir))
    return rounded(season.select("sport", "season", "team", "home_away_split"), "home_away_split")


QUERIES["home_away_split"] = home_away_split
CHECKS["home_away_split"] = check_sql(
    "SELECT sport, season, team, round(split, 6) AS home_away_split FROM ts", ts=_TS
)


def pythag_luck(spark, sf_dir):
    season = features.with_expected_record(features.team_season(history(spark, sf_dir)))
    season = season.select("sport", "season", "team", "pythagorean_win_pct", "expected_wins", "luck")
    # Adding zero turns a rounded -0.0 into 0.0.
    return rounded(season, "pythagorean_win_pct", "expected_wins", "luck").withColumn("luck", F.col("luck") + 0.0)


QUERIES["pythag_luck"] = pythag_luck
CHECKS["pythag_luck"] = check_sql("""
SELECT sport, season, team, round(py, 6) AS pythagorean_win_pct, round(py * games_played, 6) AS expected_wins,
       round(wins - py * games_played, 6) + 0.0::DOUBLE AS luck
FROM (SELECT *, pow(points_for, ex) / nullif(pow(points_for, ex) + pow(points_against, ex), 0) AS py
      FROM (SELECT *, CASE sport WHEN 'MLB' THEN 1.83::DOUBLE WHEN 'NFL' THEN 2.37::DOUBLE ELSE 13.91::DOUBLE END AS ex FROM ts))""", ts=_TS)  # fmt: skip


def ratings(spark, sf_dir):
    return features.simple_ratings(features.pairings(history(spark, sf_dir)), SRS_ROUNDS)


def srs_k(spark, sf_dir):
    # Nine digits: a tie at the last one would need a denominator of 1024.
    return ratings(spark, sf_dir).withColumns({n: F.round(n, 9) for n in ("srs", "sos")})


QUERIES["srs_k"] = srs_k
_SRS = {
    "pairs": "SELECT sport, season, team, opponent, count(*) AS n, sum(margin) AS m FROM team_games GROUP BY ALL",
    "r1": "SELECT sport, season, team, sum(m) / sum(n) AS srs, 0.0::DOUBLE AS sos FROM pairs GROUP BY ALL",
}
for _i in range(2, SRS_ROUNDS + 1):
    _SRS[f"r{_i}"] = f"""
SELECT p.sport, p.season, p.team, sum(m) / sum(n) + sum(r.srs * n) / sum(n) AS srs, sum(r.srs * n) / sum(n) AS sos
FROM pairs p JOIN r{_i - 1} r ON p.sport = r.sport AND p.season = r.season AND p.opponent = r.team
GROUP BY p.sport, p.season, p.team"""
CHECKS["srs_k"] = check_sql(
    f"SELECT sport, season, team, round(srs, 9) AS srs, round(sos, 9) AS sos FROM r{SRS_ROUNDS}", **_SRS
)


def sos_rank(spark, sf_dir):
    ranked = features.with_sos_rank(ratings(spark, sf_dir).withColumn("sos", F.round("sos", 9)))
    return ranked.drop("srs")


QUERIES["sos_rank"] = sos_rank
CHECKS["sos_rank"] = check_sql(
    f"""SELECT sport, season, team, sos, CAST(rank() OVER (PARTITION BY sport, season ORDER BY sos DESC) AS INTEGER) AS sos_rank
FROM (SELECT sport, season, team, round(sos, 9) AS sos FROM r{SRS_ROUNDS})""",
    **_SRS,
)

NBA_BOX = ["points", "fg_made", "fg_attempted", "three_made", "ft_attempted", "oreb", "dreb", "tov"]
NFL_BOX = ["yards", "turnovers", "third_att", "third_made", "red_zone_trips", "red_zone_scores", "possession_sec"]


def _sides(measures):
    """SQL: both sides' totals per game, two rows each."""
    own = ", ".join(
        f"sum({m}) FILTER (is_home) AS h_{m}, sum({m}) FILTER (NOT is_home) AS a_{m}" for m in measures
    )
    pick = lambda a, b: ", ".join(
        f"coalesce({a}_{m}, 0) AS {m}, coalesce({b}_{m}, 0) AS opp_{m}" for m in [*measures, "lines"]
    )
    return f"""
SELECT g.sport, {{season}} AS season, s.* FROM (
  SELECT game_id, home_team AS team, {pick('h', 'a')} FROM bg JOIN games USING (game_id)
  UNION ALL SELECT game_id, away_team, {pick('a', 'h')} FROM bg JOIN games USING (game_id)) s
JOIN games g ON g.game_id = s.game_id""", (
        f"SELECT game_id, {own}, count(*) FILTER (is_home) AS h_lines, "
        "count(*) FILTER (NOT is_home) AS a_lines FROM box GROUP BY game_id"
    )


_TURN = (
    "CAST(CASE WHEN sport = 'MLB' OR month(game_date) * 100 + day(game_date) >= 1022 THEN year(game_date) "
    "ELSE year(game_date) - 1 END AS INTEGER)"
)
_nba_sides, _nba_bg = _sides(NBA_BOX)
_nfl_sides, _nfl_bg = _sides(NFL_BOX)
NBA_VIEWS = {"bg": _nba_bg, "sides": _nba_sides.format(season=_TURN)}
NFL_VIEWS = {"bg": _nfl_bg, "sides": _nfl_sides.format(season=_TURN)}


def four_factors(spark, sf_dir):
    table = features.four_factors(box(spark, sf_dir, "NBA", NBA_BOX))
    return rounded(table, "pace", "off_rtg", "def_rtg", "efg_pct", "tov_pct", "oreb_pct")


QUERIES["four_factors"] = four_factors
FOUR_FACTORS_SQL = """
SELECT sport, season, team, n AS games_played, (ps + ops) / 2 / n AS pace, pts * 100 / nullif(ps, 0) AS off_rtg, opts * 100 / nullif(ops, 0) AS def_rtg,
       (fgm + 0.5::DOUBLE * tm) / nullif(fga, 0) AS efg_pct, tov / nullif(fga + 0.44::DOUBLE * fta + tov, 0) AS tov_pct,
       oreb / nullif(oreb + odreb, 0) AS oreb_pct
FROM (SELECT sport, season, team, count(*) AS n, sum(points)::DOUBLE AS pts, sum(opp_points)::DOUBLE AS opts,
        sum(fg_made)::DOUBLE AS fgm, sum(three_made)::DOUBLE AS tm, sum(fg_attempted)::DOUBLE AS fga, sum(ft_attempted)::DOUBLE AS fta,
        sum(tov)::DOUBLE AS tov, sum(oreb)::DOUBLE AS oreb, sum(opp_dreb)::DOUBLE AS odreb,
        sum(fg_attempted) + sum(ft_attempted) * 0.44::DOUBLE - sum(oreb) + sum(tov) AS ps,
        sum(opp_fg_attempted) + sum(opp_ft_attempted) * 0.44::DOUBLE - sum(opp_oreb) + sum(opp_tov) AS ops
      FROM sides WHERE sport = 'NBA' GROUP BY sport, season, team)"""
CHECKS["four_factors"] = check_sql("""
SELECT sport, season, team, games_played, round(pace, 6) AS pace, round(off_rtg, 6) AS off_rtg, round(def_rtg, 6) AS def_rtg,
       round(efg_pct, 6) AS efg_pct, round(tov_pct, 6) AS tov_pct, round(oreb_pct, 6) AS oreb_pct FROM ff""", ff=FOUR_FACTORS_SQL, **NBA_VIEWS)  # fmt: skip


def drive_stats(spark, sf_dir):
    table = features.drive_efficiency(box(spark, sf_dir, "NFL", NFL_BOX))
    return rounded(
        table, "avg_yards_per_drive", "avg_turnovers_per_game", "avg_third_down_pct", "avg_red_zone_pct"
    )


QUERIES["drive_stats"] = drive_stats
DRIVES_SQL = """
SELECT sport, season, team, n AS games_played, CAST(oto - tos AS BIGINT) AS turnover_differential, yds / nullif(ln, 0) AS avg_yards_per_drive,
       tos::DOUBLE / n AS avg_turnovers_per_game, tm / nullif(ta, 0) AS avg_third_down_pct, rs / nullif(rt, 0) AS avg_red_zone_pct,
       CAST(floor(sec / n) AS BIGINT) AS possession_seconds,
       (CAST(floor(sec / n) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(floor(sec / n) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS avg_time_of_possession
FROM (SELECT sport, season, team, count(*) AS n, sum(yards)::DOUBLE AS yds, sum(turnovers) AS tos, sum(opp_turnovers) AS oto,
        sum(third_att)::DOUBLE AS ta, sum(third_made)::DOUBLE AS tm, sum(red_zone_trips)::DOUBLE AS rt, sum(red_zone_scores)::DOUBLE AS rs,
        sum(possession_sec)::DOUBLE AS sec, sum(lines)::DOUBLE AS ln
      FROM sides WHERE sport = 'NFL' GROUP BY sport, season, team)"""
CHECKS["drive_stats"] = check_sql("""
SELECT * REPLACE (round(avg_yards_per_drive, 6) AS avg_yards_per_drive, round(avg_turnovers_per_game, 6) AS avg_turnovers_per_game,
       round(avg_third_down_pct, 6) AS avg_third_down_pct, round(avg_red_zone_pct, 6) AS avg_red_zone_pct) FROM dr""", dr=DRIVES_SQL, **NFL_VIEWS)  # fmt: skip


def player_season(spark, sf_dir):
    games = tables.games(spark, sf_dir).filter("sport = 'NBA'")
    return rounded(features.player_season(tables.box_lines(spark, sf_dir), games), "three_pct", "ft_pct")


QUERIES["player_season"] = player_season
_SUMS = "minutes points assists steals blocks fg_made fg_attempted three_made three_attempted ft_made ft_attempted".split()
PLAYERS_SQL = f"""
SELECT sport, {_TURN} AS season, player_id, count(DISTINCT game_id) AS games_played,
       {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS)}, CAST(sum(oreb + dreb) AS BIGINT) AS rebounds,
       sum(three_made) / nullif(sum(three_attempted), 0) AS three_pct, sum(ft_made) / nullif(sum(ft_attempted), 0) AS ft_pct
FROM box JOIN games USING (game_id) WHERE sport = 'NBA' GROUP BY 1, 2, 3"""
CHECKS["player_season"] = check_sql(
    "SELECT * REPLACE (round(three_pct, 6) AS three_pct, round(ft_pct, 6) AS ft_pct) FROM players",
    players=PLAYERS_SQL,
)

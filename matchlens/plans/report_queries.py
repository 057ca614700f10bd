"""Team, player and advanced tables."""

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.functions.times import default_season_of
from matchlens.operators import features, joins, reconcile, reports, search
from matchlens.operators.reports import Sort
from matchlens.plans import feature_queries as fq
from matchlens.plans.views import check_sql, fixed
from matchlens.session import shared_dir
from matchlens.sources import tables

QUERIES, CHECKS = {}, {}

GROUP = ["sport", "season"]


def team_stats(spark, sf_dir):
    """Season rows under the names the team tables read."""
    rows = fq.history(spark, sf_dir)
    season = features.team_season(rows).join(features.current_streak(rows), features.TEAM_SEASON)
    runs = F.col("sport") == "MLB"
    return season.select(
        "sport", "season", F.col("team").alias("team_name"), "wins_all_percentage", "current_form", "games_played",
        F.when(~runs, F.col("for_avg")).alias("points_for_avg_all"),
        F.when(~runs, F.col("against_avg")).alias("points_against_avg_all"),
        F.when(runs, F.col("for_avg")).alias("runs_for_avg_all"),
        F.when(runs, F.col("against_avg")).alias("runs_against_avg_all"),
    )


def adv_mlb(spark, sf_dir):
    season = features.team_season(fq.history(spark, sf_dir)).filter("sport = 'MLB'")
    return features.with_expected_record(season).select(
        "sport", "season", F.col("team").alias("team_name"), F.col("wins_all_percentage").alias("win_pct"),
        "pythagorean_win_pct", F.col("differential").alias("run_differential"),
        F.col("differential_avg").alias("run_differential_avg"), F.col("luck").alias("luck_factor"), "games_played",
    )


def player_stats(spark, sf_dir):
    games = tables.games(spark, sf_dir).filter("sport = 'NBA'")
    players = features.player_season(tables.box_lines(spark, sf_dir), games)
    supplier = tables.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("player_name"),
        F.col("s_nationkey").cast("long").alias("n"),
    )
    named = supplier.join(tables.nation_names(spark, sf_dir), "n").withColumnRenamed("team", "team_name").drop("n")
    return players.join(named, "player_id")


def nfl_summary(spark, sf_dir):
    """Summary rows as they arrive: snake case, season as text, SRS under another name."""
    drives = features.drive_efficiency(fq.box(spark, sf_dir, "NFL", fq.NFL_BOX))
    record = features.with_expected_record(features.team_season(fq.history(spark, sf_dir)))
    # A rounded key keeps the table's order clear of differences in the last bit.
    srs = F.round(F.col("differential_avg"), 4)
    odd = F.col("games_played") % 5 == 0
    return drives.drop("games_played").join(record.filter("sport = 'NFL'"), features.TEAM_SEASON).select(
        F.col("season").cast("string").alias("season"), F.col("team").alias("team_name"),
        F.when(~odd, srs).alias("srs_lite"), F.col("wins_all_percentage").alias("win_pct"),
        "pythagorean_win_pct", "avg_third_down_pct", "avg_red_zone_pct", "avg_yards_per_drive",
        "avg_turnovers_per_game", "avg_time_of_possession",
    )


def team_sort(spark, sf_dir):
    """Both directions of the team order, with the win share missing for short seasons."""
    stats = team_stats(spark, sf_dir).withColumn(
        "wins_all_percentage", F.when(F.col("games_played") % 4 != 0, F.col("wins_all_percentage"))
    )
    up = reports.ranked(stats, "teams", Sort("wins_all_percentage", "asc"), GROUP).withColumnRenamed("position", "up")
    both = reports.ranked(up, "teams", Sort("wins_all_percentage", "desc"), GROUP)
    text = reports.ranked(
        both.withColumnRenamed("position", "down"), "teams", Sort("current_form", "desc"), GROUP
    )
    return text.select("sport", "season", "team_name", "up", "down", F.col("position").alias("by_form"))


QUERIES["team_sort"] = team_sort
_STREAK = """
SELECT sport, season, team, result || n AS current_form FROM (
  SELECT sport, season, team, result, count(*) AS n,
         row_number() OVER (PARTITION BY sport, season, team ORDER BY max(rn) DESC) AS place
  FROM (SELECT *, rn - row_number() OVER (PARTITION BY sport, season, team, result ORDER BY start_ts, game_id) AS grp
        FROM (SELECT *, row_number() OVER (PARTITION BY sport, season, team ORDER BY start_ts, game_id) AS rn FROM team_games))
  GROUP BY sport, season, team, result, grp) WHERE place = 1"""
STATS = {"ts": fq._TS, "st": _STREAK}
CHECKS["team_sort"] = check_sql("""
SELECT sport, season, team AS team_name,
       row_number() OVER (PARTITION BY sport, season ORDER BY w ASC NULLS FIRST, team) AS up,
       row_number() OVER (PARTITION BY sport, season ORDER BY w DESC NULLS FIRST, team DESC) AS down,
       row_number() OVER (PARTITION BY sport, season ORDER BY current_form DESC NULLS FIRST, team DESC) AS by_form
FROM (SELECT *, CASE WHEN games_played % 4 <> 0 THEN win_share END AS w FROM ts JOIN st USING (sport, season, team))""", **STATS)  # fmt: skip


def player_sort(spark, sf_dir):
    players = player_stats(spark, sf_dir).withColumn("points", F.when(F.col("games_played") % 3 != 0, F.col("points")))
    by = lambda df, d: reports.ranked(
        df, "players", Sort("points", d), GROUP, name="player_name", row_id="player_id"
    ).withColumnRenamed("position", d)
    slim = players.select("sport", "season", "player_id", "player_name", "points")
    return by(by(slim, "asc"), "desc").drop("player_name")


QUERIES["player_sort"] = player_sort
CHECKS["player_sort"] = check_sql(
    """
SELECT sport, season, player_id, pts AS points,
       row_number() OVER (PARTITION BY sport, season ORDER BY pts ASC NULLS FIRST, player_id) AS "asc",
       row_number() OVER (PARTITION BY sport, season ORDER BY pts DESC NULLS LAST, player_id) AS "desc"
FROM (SELECT *, CASE WHEN games_played % 3 <> 0 THEN points END AS pts FROM players)""",
    players=fq.PLAYERS_SQL,
)


def adv_sort(spark, sf_dir):
    """Default order of the three advanced tables, keys rounded clear of float noise."""
    nba = features.four_factors(fq.box(spark, sf_dir, "NBA", fq.NBA_BOX))
    nba = nba.withColumn("off_rtg", F.round("off_rtg", 4)).withColumnRenamed("team", "team_name")
    nfl = fq.ratings(spark, sf_dir).filter("sport = 'NFL'").withColumnRenamed("team", "team_name")
    nfl = nfl.withColumn("srs", F.when(F.col("team_name") != "NATION_3", F.round("srs", 4)))
    out = []
    for league, df in (("NBA", nba), ("MLB", adv_mlb(spark, sf_dir)), ("NFL", nfl)):
        sort = reports.DEFAULT_SORT[league, "advanced"]
        sorted_rows = reports.ranked(df, "advanced", sort, GROUP, league=league)
        out.append(sorted_rows.select("sport", "season", "team_name", "position"))
    return reconcile.league_union(*out)


QUERIES["adv_sort"] = adv_sort
CHECKS["adv_sort"] = check_sql(
    f"""
SELECT sport, season, team AS team_name, row_number() OVER (PARTITION BY sport, season ORDER BY round(off_rtg, 4) DESC, team) AS position FROM ff
UNION ALL
SELECT sport, season, team, row_number() OVER (PARTITION BY sport, season ORDER BY differential DESC, team) FROM ts WHERE sport = 'MLB'
UNION ALL
SELECT sport, season, team, row_number() OVER (PARTITION BY sport, season ORDER BY
  CASE WHEN team <> 'NATION_3' THEN round(srs, 4) END DESC NULLS LAST, team DESC)
FROM r{fq.SRS_ROUNDS} WHERE sport = 'NFL'""",
    ff=fq.FOUR_FACTORS_SQL, ts=fq._TS, **fq.NBA_VIEWS, **fq._SRS,
)


def format_cells(spark, sf_dir):
    """Baseball team and advanced tables as printed."""
    advanced = adv_mlb(spark, sf_dir)
    shown = reports.ranked(advanced, "advanced", reports.DEFAULT_SORT["MLB", "advanced"], GROUP, league="MLB")
    return reports.printed(shown, "MLB", "advanced", ["season", "position"])


QUERIES["format_cells"] = format_cells
CHECKS["format_cells"] = check_sql(f"""
SELECT season, row_number() OVER (PARTITION BY season ORDER BY differential DESC, team) AS position, team AS team_name,
       {fixed('win_share', 1)} AS win_pct, {fixed('py', 1)} AS pythag_win_pct, {fixed('differential::DOUBLE', 0)} AS run_differential,
       {fixed('differential_avg', 1)} AS run_differential_avg, {fixed('wins - py * games_played', 0)} AS luck_factor,
       {fixed('games_played::DOUBLE', 0)} AS gp
FROM (SELECT *, pow(points_for, 1.83::DOUBLE) / (pow(points_for, 1.83::DOUBLE) + pow(points_against, 1.83::DOUBLE)) AS py
      FROM ts WHERE sport = 'MLB')""", ts=fq._TS)  # fmt: skip


def report_teams(spark, sf_dir):
    """Baseball and basketball team tables in opening order, as printed."""
    stats = team_stats(spark, sf_dir)
    out = []
    for league in ("MLB", "NBA"):
        rows = stats.filter(F.col("sport") == league)
        shown = reports.ranked(rows, "teams", reports.DEFAULT_SORT[league, "teams"], GROUP)
        out.append(reports.printed(shown, league, "teams", ["sport", "season", "position"]))
    return reconcile.league_union(*out)


QUERIES["report_teams"] = report_teams
CHECKS["report_teams"] = check_sql(f"""
SELECT sport, season, row_number() OVER (PARTITION BY sport, season ORDER BY win_share DESC, team DESC) AS position,
       team AS team_name, {fixed('win_share * 100', 1)} || '%' AS wins_all_percentage,
       CASE WHEN sport = 'MLB' THEN {fixed('for_avg', 1)} END AS runs_for_avg_all,
       CASE WHEN sport = 'MLB' THEN {fixed('against_avg', 1)} END AS runs_against_avg_all,
       CASE WHEN sport = 'NBA' THEN {fixed('for_avg', 1)} END AS points_for_avg_all,
       CASE WHEN sport = 'NBA' THEN {fixed('against_avg', 1)} END AS points_against_avg_all, current_form
FROM ts JOIN st USING (sport, season, team) WHERE sport IN ('MLB', 'NBA')""", **STATS)  # fmt: skip


def report_nfl(spark, sf_dir):
    """Football team table: normalised summary rows in opening order, as printed."""
    rows = reconcile.normalize_summary(nfl_summary(spark, sf_dir))
    shown = reports.ranked(
        rows, "teams", reports.DEFAULT_SORT["NFL", "teams"], ["season"], name="teamName", row_id="teamName"
    )
    return reports.printed(shown, "NFL", "teams", ["season", "position"])


QUERIES["report_nfl"] = report_nfl
CHECKS["report_nfl"] = check_sql(f"""
SELECT season, row_number() OVER (PARTITION BY season ORDER BY
         CASE WHEN ts.games_played % 5 <> 0 THEN round(differential_avg, 4) END DESC NULLS FIRST, team DESC) AS position,
       team AS "teamName", {fixed('win_share * 100', 1)} || '%' AS "winPct", {fixed('avg_yards_per_drive', 1)} AS "avgYardsPerDrive",
       coalesce({fixed('avg_red_zone_pct * 100', 1)} || '%', '–') AS "avgRedZonePct", avg_time_of_possession AS "avgTimeOfPossession",
       {fixed('avg_turnovers_per_game', 1)} AS "avgTurnoversPerGame"
FROM ts JOIN dr USING (sport, season, team)""", ts=fq._TS, dr=fq.DRIVES_SQL, **fq.NFL_VIEWS)  # fmt: skip


def report_players(spark, sf_dir):
    """Basketball player table of a name search, in input order, as printed."""
    players = reports.search_players(player_stats(spark, sf_dir), "#00000")
    return reports.printed(players, "NBA", "players", ["season", "player_id"])


QUERIES["report_players"] = report_players
CHECKS["report_players"] = check_sql(f"""
SELECT season, player_id, s_name AS player_name, n_name AS team_name, CAST(points AS VARCHAR) AS points,
       CAST(rebounds AS VARCHAR) AS rebounds, CAST(assists AS VARCHAR) AS assists,
       coalesce({fixed('three_pct * 100', 1)} || '%', '–') AS three_pct, coalesce({fixed('ft_pct * 100', 1)} || '%', '–') AS ft_pct,
       CAST(minutes AS VARCHAR) AS minutes, CAST(games_played AS VARCHAR) AS games_played
FROM players JOIN supplier ON player_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE lower(s_name) LIKE '%#00000%'""", players=fq.PLAYERS_SQL)  # fmt: skip


TERMS = ("SUPPLIER#", "#00000001", "no such name", "9", "")


def player_search(spark, sf_dir):
    """Name searches through a stored posting table: all, some and no players, and terms too short for it."""
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    players = player_stats(spark, sf_dir)
    search.write_postings(players, path, "player_id")
    found = [
        search.search_postings(spark, players, path, term, "player_id").select(
            F.lit(term).alias("term"), "sport", "season", "player_id", "player_name"
        )
        for term in TERMS
    ]
    return reduce(DataFrame.unionByName, found)


QUERIES["player_search"] = player_search
CHECKS["player_search"] = check_sql(f"""
SELECT term, sport, season, player_id, s_name AS player_name
FROM players JOIN supplier ON player_id = s_suppkey, (VALUES {", ".join(f"('{t}')" for t in TERMS)}) v(term)
WHERE contains(lower(s_name), lower(term))""", players=fq.PLAYERS_SQL)  # fmt: skip


def nfl_adv_merge(spark, sf_dir):
    """Advanced rows completed from wrapped lookups and the flat summary.

    Ratings are spread over the sources: a third sit in the row, under varying
    names; the lookups spell team names differently and one has a gap.
    """
    teams = features.team_season(fq.history(spark, sf_dir)).filter("sport = 'NFL'")
    n = F.regexp_extract("team", r"(\d+)$", 1).cast("int")
    teams = teams.withColumn("n", n).withColumn("pos", n)
    value = F.round("differential_avg", 4)
    spaced = F.concat(F.lower(F.substring("team", 1, 3)), F.lit(" "), F.substring("team", 4, 20))
    advanced = teams.select(
        "season", F.col("team").alias("team_name"), "games_played", "pos",
        F.when(n % 3 == 0, value).alias("srs"), F.when(n % 6 == 1, value + 1).alias("srs_rating"),
        F.when(n % 4 == 0, (value * 2).cast("string")).when(n % 4 == 1, "").alias("sos"),
    )
    from_summary = teams.filter(n % 2 == 0).select("season", spaced.alias("teamName"), "pos", (value + 2).alias("srs_lite"))
    from_advanced = teams.filter(n % 5 < 3).select(
        "season", spaced.alias("team_name"), "pos", F.when(n % 10 != 2, value + 3).alias("srs")
    )
    sos = teams.filter(n % 3 == 1).select("season", spaced.alias("team_name"), "pos", (value + 4).alias("sos_rating"))
    flat = teams.filter(n < 20).select(
        "season", F.upper("team").alias("team_name"), "pos", (value + 5).alias("srs"), (value + 6).alias("strength_of_schedule")
    )
    merged = joins.merge_nfl_advanced(advanced, [from_summary, from_advanced], [sos], flat)
    return merged.select("season", "team_name", F.round("srs", 4).alias("srs"), F.round("sos", 4).alias("sos"))


QUERIES["nfl_adv_merge"] = nfl_adv_merge
CHECKS["nfl_adv_merge"] = check_sql("""
SELECT season, team AS team_name,
  round(CASE WHEN n % 3 = 0 THEN v WHEN n % 6 = 1 THEN v + 1
       WHEN n % 5 < 3 AND n % 10 <> 2 THEN v + 3 WHEN n % 5 < 3 THEN CASE WHEN n < 20 THEN v + 5 END
       WHEN n % 2 = 0 THEN v + 2 WHEN n < 20 THEN v + 5 END, 4) AS srs,
  round(CASE WHEN n % 4 = 0 THEN v * 2 WHEN n % 3 = 1 THEN v + 4 WHEN n < 20 THEN v + 6 END, 4) AS sos
FROM (SELECT season, team, round(differential_avg, 4) AS v, CAST(regexp_extract(team, '(\\d+)$', 1) AS INTEGER) AS n
      FROM ts WHERE sport = 'NFL')""", ts=fq._TS)  # fmt: skip


def season_gate(spark, sf_dir):
    """Team seasons a viewer may open on a fixed day."""
    stats = team_stats(spark, sf_dir)
    allowed = F.lit(False)
    for league in ("MLB", "NFL", "NBA"):
        default = F.lit(default_season_of(league, date(1998, 6, 15)))
        gate = reports.season_allowed(league, F.col("season"), default)
        allowed = allowed | ((F.col("sport") == league) & gate)
    return stats.filter(allowed).select("sport", "season", "team_name")


QUERIES["season_gate"] = season_gate
CHECKS["season_gate"] = check_sql(
    "SELECT sport, season, team AS team_name FROM ts WHERE sport = 'MLB' OR season <= 1997", ts=fq._TS
)


def report_state(spark, sf_dir):
    """Whether a search for a name that nobody has comes up empty."""
    return reports.empty_message(
        reports.search_players(player_stats(spark, sf_dir), "nobody"), "players", "nobody"
    )


QUERIES["report_state"] = report_state
CHECKS["report_state"] = """
SELECT count(*) = 0 AS is_empty, CASE WHEN count(*) = 0 THEN 'No results for “nobody”' END AS message
FROM supplier WHERE lower(s_name) LIKE '%nobody%'"""

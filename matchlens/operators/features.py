"""Team features from finished games and box-score lines.

Formulas are the published ones; nothing here claims parity with a private
model. Per-game history (form, rest, meetings) runs on globally sorted blocks,
so that a team with most of the games does not end up in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.times import default_season
from matchlens.params import PYTHAGOREAN_EXPONENT, per_league
from matchlens.session import written
from matchlens.skew import in_block, salted_join, sorted_blocks

TEAM_SEASON = ["sport", "season", "team"]
TEAM_ORDER = ["sport", "team", "start_ts", "game_id"]


def team_games(games: DataFrame) -> DataFrame:
    """Two rows per finished game, one per side."""

    def side(own, other, is_home):
        return F.struct(
            F.col(f"{own}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.lit(is_home).alias("is_home"),
            F.col(f"{own}_final").alias("pf"),
            F.col(f"{other}_final").alias("pa"),
        )

    both = F.inline(F.array(side("home", "away", True), side("away", "home", False)))
    played = games.filter("home_final IS NOT NULL AND away_final IS NOT NULL")
    rows = played.select("game_id", "sport", "game_date", "start_ts", both)
    return rows.withColumns(
        {
            "season": default_season(F.col("sport"), F.col("game_date")),
            "margin": F.col("pf") - F.col("pa"),
            "result": F.when(F.col("pf") > F.col("pa"), "W")
            .when(F.col("pf") < F.col("pa"), "L")
            .otherwise("T"),
        }
    )


FORM = {"form_for": "pf", "form_against": "pa", "form_margin": "margin"}


def team_history(rows: DataFrame, n: int = 5) -> DataFrame:
    """Form over each team's previous ``n`` games and the rest before each game.

    The current game is excluded. One global sort and one window serve all
    columns; those not used later are pruned.
    """
    slim = rows.select("game_id", "sport", "team", "start_ts", "game_date", *FORM.values())
    history = sorted_blocks(slim, TEAM_ORDER).with_carry(n)
    mine = in_block(["sport", "team"])
    before = mine.rowsBetween(-n, -1)
    rested = F.date_diff(F.col("game_date"), F.lag("game_date").over(mine))
    return (
        history.withColumns(
            {
                "form_games": F.count("game_id").over(before),
                **{name: F.avg(c).over(before) for name, c in FORM.items()},
                "rest_days": rested,
            }
        )
        .filter("NOT _carried")
        .drop("_pos", "_block", "_carried")
        .withColumn("back_to_back", F.coalesce(F.col("rest_days") <= 1, F.lit(False)))
    )


def rolling_form(rows: DataFrame, n: int = 5) -> DataFrame:
    """Averages of each team's previous ``n`` games, the current one excluded."""
    return team_history(rows, n).drop("rest_days", "back_to_back")


def schedule_density(rows: DataFrame, days: int = 7) -> DataFrame:
    """Games in the ``days`` before each team's playing day.

    Counted per day first; the window then holds one row per calendar day.
    """
    daily = rows.groupBy("sport", "team", "game_date").agg(F.count("*").alias("on_day"))
    day = F.unix_date("game_date")
    span = Window.partitionBy("sport", "team").orderBy(day).rangeBetween(-days, -1)
    recent = F.coalesce(F.sum("on_day").over(span), F.lit(0).cast("long"))
    return daily.select("sport", "team", "game_date", recent.alias("recent_games"))


def with_density(history: DataFrame, rows: DataFrame, days: int = 7) -> DataFrame:
    """Adds ``recent_games`` to per-game history."""
    keys = ["sport", "team", "game_date"]
    return salted_join(history, schedule_density(rows, days), keys, spread=["game_id"], sketch=rows)


def rest_days(rows: DataFrame, days: int = 7) -> DataFrame:
    """Days since the team's previous game, back-to-back flag and schedule density."""
    return with_density(team_history(rows, 1).drop("form_games", *FORM), rows, days)


def head_to_head(games: DataFrame) -> DataFrame:
    """Earlier meetings of the same two teams, from the home side's view."""
    a, b = F.least("home_team", "away_team"), F.greatest("home_team", "away_team")
    a_margin = F.when(F.col("home_team") == a, 1).otherwise(-1) * (
        F.col("home_final") - F.col("away_final")
    )
    pairs = games.filter("home_final IS NOT NULL AND away_final IS NOT NULL").select(
        "game_id", "sport", "start_ts", "home_team",
        a.alias("team_a"), b.alias("team_b"),
        a_margin.alias("m"), F.when(a_margin > 0, 1).otherwise(0).cast("long").alias("w"),
        F.when(a_margin < 0, 1).otherwise(0).cast("long").alias("l"), F.lit(1).cast("long").alias("one"),
    )
    keys = ["sport", "team_a", "team_b"]
    met = sorted_blocks(pairs, [*keys, "start_ts", "game_id"]).running(
        keys, inclusive=False, meetings=("sum", "one"), a_wins=("sum", "w"),
        b_wins=("sum", "l"), a_margin=("sum", "m"),
    )
    home_is_a = F.col("home_team") == F.col("team_a")
    mean = F.try_divide(F.col("a_margin"), F.col("meetings"))
    return met.select(
        "game_id", "sport", "team_a", "team_b", "meetings",
        F.when(home_is_a, F.col("a_wins")).otherwise(F.col("b_wins")).alias("home_wins"),
        F.when(home_is_a, mean).otherwise(-mean).alias("home_margin_avg"),
    )


def current_streak(rows: DataFrame) -> DataFrame:
    """Each team's run of equal results at the end of its season, such as ``W3``.

    The last game of every result kind comes from one aggregation; the run is
    what lies after the last game with another result.
    """
    at = F.struct("start_ts", "game_id")
    lasts = rows.groupBy(*TEAM_SEASON).agg(
        F.max_by("result", at).alias("last_result"),
        *[F.max(F.when(F.col("result") == r, at)).alias(f"last_{r}") for r in "WLT"],
    )
    others = [F.when(F.col("last_result") != r, F.col(f"last_{r}")) for r in "WLT"]
    lasts = lasts.select(*TEAM_SEASON, "last_result", F.greatest(*others).alias("broken_at"))
    slim = rows.select(*TEAM_SEASON, "start_ts", "game_id")
    tail = salted_join(slim, lasts, TEAM_SEASON, spread=["game_id"]).filter(
        F.col("broken_at").isNull() | (at > F.col("broken_at"))
    )
    runs = tail.groupBy(*TEAM_SEASON, "last_result").agg(F.count("*").alias("run"))
    form = F.concat("last_result", F.col("run").cast("string"))
    return runs.select(*TEAM_SEASON, form.alias("current_form"))


def team_season(rows: DataFrame) -> DataFrame:
    """Record, scoring, differential and home/away split per team and season."""
    home = F.col("is_home")
    return rows.groupBy(*TEAM_SEASON).agg(
        F.count("*").alias("games_played"),
        F.count_if(F.col("result") == "W").alias("wins"),
        F.avg(F.when(F.col("result") == "W", 1.0).otherwise(0.0)).alias("wins_all_percentage"),
        F.sum("pf").alias("points_for"),
        F.sum("pa").alias("points_against"),
        F.avg("pf").alias("for_avg"),
        F.avg("pa").alias("against_avg"),
        F.sum("margin").alias("differential"),
        F.avg("margin").alias("differential_avg"),
        (F.avg(F.when(home, F.col("margin"))) - F.avg(F.when(~home, F.col("margin")))).alias(
            "home_away_split"
        ),
    )


def with_expected_record(season: DataFrame) -> DataFrame:
    """Pythagorean win share and wins, and luck: actual minus expected wins."""
    k = per_league(PYTHAGOREAN_EXPONENT, 2.0)
    scored, allowed = F.pow("points_for", k), F.pow("points_against", k)
    return (
        season.withColumn("pythagorean_win_pct", F.try_divide(scored, scored + allowed))
        .withColumn("expected_wins", F.col("pythagorean_win_pct") * F.col("games_played"))
        .withColumn("luck", F.col("wins") - F.col("expected_wins"))
    )


def pairings(rows: DataFrame) -> DataFrame:
    """Games and summed margin per season, team and opponent."""
    return rows.groupBy(*TEAM_SEASON, "opponent").agg(
        F.count("*").alias("n"), F.sum("margin").alias("margin")
    )


def simple_ratings(pairs: DataFrame, rounds: int = 5, fix_every: int = 4) -> DataFrame:
    """SRS after a fixed number of rounds, and SoS.

    ``srs = average margin + average opponent srs``, starting from zero. Works
    on the pairings, whose size does not grow with the number of games; they
    are written once, and so are the ratings every few rounds.
    """
    pairs = written(pairs, "pairings")
    ratings = pairs.groupBy(*TEAM_SEASON).agg(
        (F.sum("margin") / F.sum("n")).alias("srs"), F.lit(0.0).alias("sos")
    )
    for i in range(1, rounds):
        if i % fix_every == 0:
            ratings = written(ratings, "ratings")
        against = ratings.select(
            "sport", "season", F.col("team").alias("opponent"), F.col("srs").alias("opp_srs")
        )
        met = pairs.join(against, ["sport", "season", "opponent"])
        ratings = met.groupBy(*TEAM_SEASON).agg(
            ((F.sum("margin") + F.sum(F.col("opp_srs") * F.col("n"))) / F.sum("n")).alias("srs"),
            (F.sum(F.col("opp_srs") * F.col("n")) / F.sum("n")).alias("sos"),
        )
    return ratings


def with_sos_rank(ratings: DataFrame) -> DataFrame:
    """1 is the hardest schedule; one row per team, so the window stays small."""
    order = Window.partitionBy("sport", "season").orderBy(F.desc("sos"))
    return ratings.withColumn("sos_rank", F.rank().over(order))


# ---- box scores ------------------------------------------------------------

BOX = [
    "points", "fg_made", "fg_attempted", "three_made", "three_attempted", "ft_made", "ft_attempted",
    "oreb", "dreb", "tov", "yards", "turnovers", "third_att", "third_made", "red_zone_trips",
    "red_zone_scores", "possession_sec",
]


def team_box(lines: DataFrame, games: DataFrame, measures: list[str]) -> DataFrame:
    """Each side's totals next to the opponent's, two rows per game.

    Lines are summed per game before the join, so a game with very many lines
    is reduced on the map side.
    """

    def total(home):
        at = F.col("is_home") if home else ~F.col("is_home")
        prefix = "h_" if home else "a_"
        return [F.sum(F.when(at, F.col(m)).otherwise(0)).alias(prefix + m) for m in measures]

    def count(home):
        at = F.col("is_home") if home else ~F.col("is_home")
        return F.count_if(at).alias("h_lines" if home else "a_lines")

    by_game = lines.groupBy("game_id").agg(*total(True), *total(False), count(True), count(False))
    columns = measures + ["lines"]

    def view(own, other, team):
        return F.struct(
            F.col(team).alias("team"),
            *[F.col(f"{own}_{m}").alias(m) for m in columns],
            *[F.col(f"{other}_{m}").alias(f"opp_{m}") for m in columns],
        )

    names = games.select("game_id", "sport", "game_date", "home_team", "away_team")
    sides = F.inline(F.array(view("h", "a", "home_team"), view("a", "h", "away_team")))
    return by_game.join(names, "game_id").select(
        "game_id", "sport", default_season(F.col("sport"), F.col("game_date")).alias("season"), sides
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def four_factors(box: DataFrame) -> DataFrame:
    """Pace, offensive and defensive rating, eFG%, TOV% and ORB% per season."""
    sums = ["points", "fg_made", "fg_attempted", "three_made", "ft_attempted", "oreb", "dreb", "tov"]
    totals = box.groupBy(*TEAM_SEASON).agg(
        F.count("*").alias("games_played"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.sum(f"opp_{c}").alias(f"opp_{c}") for c in sums],
    )
    c = F.col
    used = lambda p: c(p + "fg_attempted") + c(p + "ft_attempted") * 0.44 - c(p + "oreb") + c(p + "tov")
    poss, opp_poss = used(""), used("opp_")
    return totals.select(
        *TEAM_SEASON, "games_played",
        _ratio((poss + opp_poss) / 2, c("games_played")).alias("pace"),
        _ratio(c("points") * 100, poss).alias("off_rtg"),
        _ratio(c("opp_points") * 100, opp_poss).alias("def_rtg"),
        _ratio(c("fg_made") + c("three_made") * 0.5, c("fg_attempted").cast("double")).alias("efg_pct"),
        _ratio(c("tov").cast("double"), c("fg_attempted") + c("ft_attempted") * 0.44 + c("tov")).alias("tov_pct"),
        _ratio(c("oreb").cast("double"), (c("oreb") + c("opp_dreb")).cast("double")).alias("oreb_pct"),
    )


def drive_efficiency(box: DataFrame) -> DataFrame:
    """Turnover differential, yards per drive, third-down and red-zone share, possession."""
    sums = ["yards", "turnovers", "opp_turnovers", "third_att", "third_made", "red_zone_trips",
            "red_zone_scores", "possession_sec", "lines"]
    totals = box.groupBy(*TEAM_SEASON).agg(
        F.count("*").alias("games_played"), *[F.sum(c).alias(c) for c in sums]
    )
    per = lambda a, b: _ratio(F.col(a).cast("double"), F.col(b).cast("double"))
    seconds = F.floor(per("possession_sec", "games_played"))
    clock = F.concat(
        F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")
    )
    return totals.select(
        *TEAM_SEASON, "games_played",
        (F.col("opp_turnovers") - F.col("turnovers")).alias("turnover_differential"),
        per("yards", "lines").alias("avg_yards_per_drive"),
        per("turnovers", "games_played").alias("avg_turnovers_per_game"),
        per("third_made", "third_att").alias("avg_third_down_pct"),
        per("red_zone_scores", "red_zone_trips").alias("avg_red_zone_pct"),
        seconds.alias("possession_seconds"),
        clock.alias("avg_time_of_possession"),
    )


def player_season(lines: DataFrame, games: DataFrame) -> DataFrame:
    """Player totals and shooting shares per season."""
    sums = ["minutes", "points", "oreb", "dreb", "assists", "steals", "blocks", "fg_made", "fg_attempted",
            "three_made", "three_attempted", "ft_made", "ft_attempted"]
    # One row per player and game first: it shrinks the join and counts games.
    by_game = lines.groupBy("game_id", "player_id").agg(*[F.sum(c).alias(c) for c in sums])
    names = games.select("game_id", "sport", default_season(F.col("sport"), F.col("game_date")).alias("season"))
    joined = salted_join(by_game, names, ["game_id"], spread=["player_id"], sketch=lines)
    totals = joined.groupBy("sport", "season", "player_id").agg(
        F.count("*").alias("games_played"), *[F.sum(c).alias(c) for c in sums]
    )
    share = lambda a, b: _ratio(F.col(a).cast("double"), F.col(b).cast("double"))
    return totals.withColumns(
        {
            "rebounds": F.col("oreb") + F.col("dreb"),
            "three_pct": share("three_made", "three_attempted"),
            "ft_pct": share("ft_made", "ft_attempted"),
        }
    ).drop("oreb", "dreb")

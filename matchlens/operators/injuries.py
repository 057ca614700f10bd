"""Injury reports of the teams on a slate.

Reports stay rows under their group key; they are never gathered into one
list, because a single team may hold a large share of them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.texts import team_key
from matchlens.skew import salted_join

INJURY_COLUMNS = ["id", "player", "team_display_name", "status", "detail", "updated", "injury_type"]


def project_injuries(raw: DataFrame) -> DataFrame:
    """The seven report columns; missing ones are NULL."""
    present = raw.columns
    return raw.select(
        *[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in INJURY_COLUMNS]
    )


def playing_teams(games: DataFrame) -> DataFrame:
    """Distinct teams per sport and day, in comparison spelling."""
    team = F.explode(F.array("home_team", "away_team"))
    return (
        games.select(F.col("sport").alias("league"), F.col("game_date").alias("report_date"), team.alias("t"))
        .filter(F.trim("t") != "")
        .select("league", "report_date", team_key(F.col("t")).alias("team_key"))
        .distinct()
    )


def injuries_of_playing(injuries: DataFrame, games: DataFrame) -> DataFrame:
    """Reports whose team plays that day; blank teams drop out."""
    keyed = injuries.withColumns(
        {"team": F.trim("team_display_name"), "team_key": team_key(F.col("team_display_name"))}
    ).filter("team <> ''")
    keys = ["league", "report_date", "team_key"]
    teams = playing_teams(games)  # distinct, so an inner join is the semi join
    return salted_join(keyed, teams, keys, spread=["id"]).drop("team_key")


def injuries_by_team(injuries: DataFrame, games: DataFrame) -> DataFrame:
    """Report counts per team as spelled; ``listed_teams`` gives their order."""
    return (
        injuries_of_playing(injuries, games)
        .groupBy("league", "report_date", "team")
        .agg(F.count("*").alias("injuries"), F.count_if(F.col("status") == "Out").alias("out"))
    )


def listed_teams(by_team: DataFrame) -> DataFrame:
    """Adds ``position``, each team's place from 1 in the list of its slate, by code unit.

    The window holds one row for each team of a slate.
    """
    units = F.encode("team", "UTF-16BE")
    slate = Window.partitionBy("league", "report_date").orderBy(units)
    return by_team.withColumn("position", F.row_number().over(slate))


def injuries_of_games(injuries: DataFrame, games: DataFrame) -> DataFrame:
    """Reports of both sides of each game, matched by exact team name and day."""
    sides = games.select(
        "game_id",
        F.col("sport").alias("league"),
        F.col("game_date").alias("report_date"),
        F.explode(F.array_distinct(F.array("home_team", "away_team"))).alias("team_display_name"),
    )
    keys = ["league", "report_date", "team_display_name"]
    return salted_join(injuries, sides, keys, spread=["id"])


def report_state(flags: DataFrame, by_team: DataFrame) -> DataFrame:
    """What the injury panel of each slate says."""
    teams = by_team.groupBy(
        F.col("league").alias("sport"), F.col("report_date").alias("game_date")
    ).agg(F.count("*").alias("teams_hurt"))
    hurt = F.coalesce("teams_hurt", F.lit(0).cast("long"))
    return flags.join(teams, ["sport", "game_date"], "left").withColumns(
        {"teams_hurt": hurt, "injury_state": _panel(hurt)}
    )


def _panel(hurt: Column) -> Column:
    return (
        F.when(F.col("is_past"), "completed")
        .when(F.col("all_filtered"), "no_remaining_games")
        .when(hurt == 0, "none_reported")
        .otherwise("list")
    )

"""Readers of the league datasets under one root folder.

Each dataset is a folder, partitioned by ``sport`` and ``game_date`` or
``season`` where it has them, so the filters below prune partitions.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.functions.times import parse_instant
from matchlens.operators.injuries import project_injuries
from matchlens.operators.reconcile import first_of, normalize_summary, tag_sport, with_game_time_et
from matchlens.operators.reports import search_players
from matchlens.sources.schemas import TABLES

# Leagues whose weather is looked up, and those with an advanced table.
OUTDOOR = ("MLB", "NFL")
ADVANCED = ("MLB", "NBA", "NFL")

# Column of the operators: keys it may arrive under, best first.
GAME_KEYS = {
    "home_team": ("homeTeam", "home_team", "homeTeamName"),
    "away_team": ("awayTeam", "away_team", "awayTeamName"),
    "status_state": ("statusState",),
    "data_type": ("dataType",),
    "home_final": ("home_final_score",),
    "away_final": ("away_final_score",),
}
WEATHER_KEYS = {
    "windSpeed": "wind_speed", "windDirection": "wind_direction", "ballparkWindText": "wind_text",
    "ballparkWindAngle": "wind_angle", "isIndoor": "is_indoor",
}


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet", **filters) -> DataFrame:
    """A dataset filtered on the given columns; a filter of ``None`` leaves no rows."""
    df = spark.read.format(fmt).schema(TABLES[name]).load(f"{root}/{name}")
    for column, value in filters.items():
        df = df.filter(F.lit(False) if value is None else F.col(column) == F.lit(value))
    return df


def canonical_games(df: DataFrame) -> DataFrame:
    """Game rows of the feeds with the columns the operators use; the feed's own columns stay.

    ``start_ts`` is the instant of ``gameTimeUTC``, by which games are live,
    stale or over; without it they cannot be judged. ``scheduled_ts`` is the
    instant shown as Eastern time: ``scheduled_time``, for football also its
    other names. The first key present counts, even if it cannot be read.
    """
    scheduled = F.when(
        F.col("sport") == "NFL", first_of(df, "scheduled_time", "gameTimeUTC", "game_time_utc")
    ).otherwise(first_of(df, "scheduled_time"))
    named = df.withColumns(
        {
            **{name: first_of(df, *keys) for name, keys in GAME_KEYS.items()},
            "start_ts": parse_instant(F.col("gameTimeUTC")),
            "scheduled_ts": parse_instant(scheduled),
        }
    )
    return with_game_time_et(named, "scheduled_ts")


def canonical_weather(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(WEATHER_KEYS)


def read_games(spark, root: str, name: str = "schedule", fmt: str = "parquet", **filters) -> DataFrame:
    """Games of all leagues and days, or those that match the filters."""
    return canonical_games(read_table(spark, root, name, fmt, **filters))


def read_schedule(spark, root: str, sport: str, day, fmt: str = "parquet") -> DataFrame:
    """One league's games of a day with start time and Eastern clock time."""
    return tag_sport(read_games(spark, root, fmt=fmt, sport=sport, game_date=day), sport)


def read_payloads(spark, path: str, row_ddl: str) -> DataFrame:
    """Rows of JSON response files: a bare array or ``{"data": [...]}``; anything else is empty.

    If the row type has an ``extra`` map, it holds the keys that the type does not list.
    """
    text = spark.read.text(path, wholetext=True)
    bare = F.ltrim("value").startswith("[")
    # Rows stay texts at first, so that each can be read with its type and for its other keys.
    texts = F.when(bare, F.from_json("value", "array<string>")).otherwise(
        F.from_json("value", "struct<data: array<string>>")["data"]
    )
    rows = text.select(F.explode(texts).alias("text")).filter(F.ltrim("text").startswith("{"))
    typed = rows.select(F.from_json("text", row_ddl).alias("row"), "text")
    listed = typed.schema["row"].dataType.names
    if "extra" not in listed:
        return typed.select("row.*")
    others = F.map_filter(F.from_json("text", "map<string, string>"), lambda k, v: ~k.isin(listed))
    return typed.select(*[F.col(f"row.`{c}`") for c in listed if c != "extra"], others.alias("extra"))


def read_historical(spark, root: str, day, fmt: str = "parquet") -> DataFrame:
    return read_games(spark, root, "historical", fmt, game_date=day)


def read_team_stats(spark, root: str, sport: str, season: int, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, root, "team_stats", fmt, sport=sport, season=season)


def read_player_stats(spark, root: str, sport: str, season: int, search: str | None = None, fmt="parquet"):
    return search_players(read_table(spark, root, "player_stats", fmt, sport=sport, season=season), search)


def read_advanced(spark, root: str, league: str, season: int, fmt: str = "parquet") -> DataFrame:
    if league not in ADVANCED:
        raise KeyError(league)
    return read_table(spark, root, f"adv_{league.lower()}", fmt, season=season)


def read_nfl_summary(spark, root: str, season: int | None, fmt: str = "parquet") -> DataFrame:
    rows = read_table(spark, root, "nfl_summary", fmt, season=None if season is None else str(season))
    return normalize_summary(rows)


def read_injury_reports(spark, root: str, fmt: str = "parquet", **filters) -> DataFrame:
    """Reports with the league and day that they are joined to games by."""
    rows = read_table(spark, root, "injuries", fmt, **filters)
    return rows.select("league", "report_date", *project_injuries(rows).columns)


def read_injuries(spark, root: str, league: str, day, fmt: str = "parquet") -> DataFrame:
    return project_injuries(read_injury_reports(spark, root, fmt, league=league, report_date=day))


def read_snapshot(spark, root: str, game_id: str, sport: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, root, "snapshots", fmt, sport=sport, game_id=game_id)


def read_weather(spark, root: str, sport: str, team: str, fmt: str = "parquet") -> DataFrame:
    """Outdoor leagues only; others have no rows."""
    outdoor = sport if sport in OUTDOOR else None
    return canonical_weather(read_table(spark, root, "weather", fmt, sport=outdoor, home_team=team))


def read_game_features(spark, root: str, game_id: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, root, "features", fmt, game_id=game_id)


def read_odds(spark, root: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, root, "odds", fmt)


def stream_table(spark, root: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """A dataset as a stream of newly arriving files: ``live`` rows or ``odds``."""
    return spark.readStream.format(fmt).schema(TABLES[name]).options(**options).load(f"{root}/{name}")


def read_jdbc(spark, url: str, table: str, column: str, lower, upper, partitions: int, **options) -> DataFrame:
    """A database table or view, read in parallel over ranges of ``column``."""
    return (
        spark.read.format("jdbc")
        .options(**jdbc_options(url, table, column, lower, upper, partitions), **options)
        .load()
    )


def jdbc_options(url: str, table: str, column: str, lower, upper, partitions: int) -> dict[str, str]:
    return {
        "url": url, "dbtable": table, "partitionColumn": column,
        "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
    }

"""The way from a feed as it is stored, through the readers, to the operators."""

import uuid

from pyspark.sql import functions as F

from matchlens.functions import odds, texts
from matchlens.functions.numbers import number_text
from matchlens.operators import edge, injuries, joins
from matchlens.plans import feature_queries, injury_queries, report_queries, slate_queries
from matchlens.plans.views import check_sql
from matchlens.session import shared_dir
from matchlens.sources import deltas, readers, sinks, tables

QUERIES, CHECKS = {}, {}

SEASON = 1995


def new_root(spark) -> str:
    return f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"


def store_schedule(spark, sf_dir, root):
    """Raw games under the names and in the types of the feed."""
    raw = tables.raw_games(spark, sf_dir).withColumnsRenamed(
        {
            "home_team": "homeTeamName", "away_team": "awayTeamName",
            "status_state": "statusState", "data_type": "dataType",
        }
    )
    feed = raw.withColumns(
        {
            "game_id": F.col("game_id").cast("string"),
            "gameTimeUTC": F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            "home_final_score": F.col("home_final").cast("double"),
            "away_final_score": F.col("away_final").cast("double"),
        }
    ).drop("start_ts", "home_final", "away_final")
    sinks.write_partitions(feed, f"{root}/schedule", ["sport"])


def read_schedule_edges(spark, sf_dir):
    """Stored games read back, reconciled, scored and labelled."""
    root = new_root(spark)
    store_schedule(spark, sf_dir, root)
    scored = edge.score_raw(readers.read_games(spark, root))
    return scored.select(
        F.col("game_id").cast("long").alias("game_id"), "sport", "ml_home_text", "spread_line", "pred_home", "side",
        "tier", F.round("edge_pct", 6).alias("edge_pct"),
        F.coalesce(odds.edge_badge(F.col("tier"), F.col("side")), F.lit("No Edge")).alias("badge"),
    )


QUERIES["read_schedule_edges"] = read_schedule_edges
CHECKS["read_schedule_edges"] = slate_queries.CHECKS["slate_edges"]


def read_injuries_playing(spark, sf_dir):
    """Stored reports of the teams on the stored schedule."""
    root = new_root(spark)
    store_schedule(spark, sf_dir, root)
    reports = tables.injuries(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    sinks.write_partitions(reports, f"{root}/injuries", ["league"])
    found = injuries.injuries_of_playing(readers.read_injury_reports(spark, root), readers.read_games(spark, root))
    return found.select(F.col("id").cast("long").alias("id"), "league", "report_date", "team", "status")


QUERIES["read_injuries_playing"] = read_injuries_playing
CHECKS["read_injuries_playing"] = injury_queries.CHECKS["injuries_semi"]


def read_player_stats(spark, sf_dir):
    """One stored season of players, found by name, with the partitions of others pruned."""
    root = new_root(spark)
    stored = report_queries.player_stats(spark, sf_dir).withColumn("player_id", F.col("player_id").cast("string"))
    counts = [c for c, kind in stored.dtypes if kind == "bigint"]
    stored = stored.withColumns({c: F.col(c).cast("double") for c in counts})
    sinks.write_partitions(stored, f"{root}/player_stats", ["sport", "season"])
    found = readers.read_player_stats(spark, root, "NBA", SEASON, "#00000001")
    return found.select(
        F.col("player_id").cast("long").alias("player_id"), "player_name", "team_name", "season", "points", "games_played",
        F.round("three_pct", 6).alias("three_pct"),
    )


QUERIES["read_player_stats"] = read_player_stats
CHECKS["read_player_stats"] = check_sql(f"""
SELECT player_id, s_name AS player_name, n_name AS team_name, season, CAST(points AS DOUBLE) AS points,
       CAST(games_played AS DOUBLE) AS games_played, round(three_pct, 6) AS three_pct
FROM players JOIN supplier ON player_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE season = {SEASON} AND contains(lower(s_name), '#00000001')""", players=feature_queries.PLAYERS_SQL)  # fmt: skip


def read_weather_labels(spark, sf_dir):
    """Stored readings at the home teams of the stored schedule."""
    root = new_root(spark)
    store_schedule(spark, sf_dir, root)
    readings = tables.weather(spark, sf_dir).select(
        F.explode(F.array(*map(F.lit, readers.OUTDOOR))).alias("sport"), "home_team", "city",
        F.col("temperature").cast("double").alias("temperature"),
        F.col("wind_speed").cast("double").alias("windSpeed"),
        F.col("wind_angle").cast("double").alias("ballparkWindAngle"),
        F.col("is_indoor").alias("isIndoor"),
    )
    sinks.write_partitions(readings, f"{root}/weather", ["sport"])
    weather = readers.canonical_weather(readers.read_table(spark, root, "weather"))
    df = joins.with_weather(readers.read_games(spark, root), weather)
    reading = [number_text(F.col("temperature")), F.coalesce(number_text(F.col("wind_speed")), F.lit(""))]
    badge = texts.weather_label(F.col("indoor"), *reading).alias("badge")
    return joins.weather_detail(df.withColumn("badge", badge)).select(
        F.col("game_id").cast("long").alias("game_id"), "indoor", "badge", "city", "stadium", "temperature",
        "feels_like", "wind", F.col("wind_angle").cast("long").alias("wind_angle"),
    )


QUERIES["read_weather_labels"] = read_weather_labels
CHECKS["read_weather_labels"] = slate_queries.CHECKS["weather_labels"]


def view_upsert(spark, sf_dir):
    """Stored games, of which every third is stored again for the next day: each stands once."""
    path = f"{new_root(spark)}/games"
    rows = tables.games(spark, sf_dir).select("game_id", "sport", "game_date", F.lit(1).alias("version"))
    moved = rows.filter("game_id % 3 = 0").withColumns(
        {"game_date": F.date_add("game_date", 1), "version": F.lit(2)}
    )
    for batch in (rows, moved):
        sinks.upsert_keyed(batch, path, ["game_id"], ["version"], buckets=8)
    return spark.read.parquet(path).drop(sinks.KEY_BUCKET)


QUERIES["view_upsert"] = view_upsert
CHECKS["view_upsert"] = check_sql("""
SELECT game_id, sport, CASE WHEN game_id % 3 = 0 THEN game_date + 1 ELSE game_date END AS game_date,
       CASE WHEN game_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM games""")


def game_batches(spark, sf_dir):
    """Stored games, then moved ones, then corrected scores together with rows that come too late."""
    rows = tables.games(spark, sf_dir).select(
        "game_id", "sport", "game_date", "home_final", "away_final", F.lit(1).alias("version")
    )
    moved = rows.filter("game_id % 3 = 0").withColumns({"game_date": F.date_add("game_date", 1), "version": F.lit(2)})
    corrected = rows.filter("game_id % 5 = 0").withColumns(
        {"home_final": F.col("home_final") + 1, "version": F.lit(3)}
    )
    late = rows.filter("game_id % 7 = 0").withColumns({"away_final": F.lit(99).cast("long"), "version": F.lit(0)})
    return [rows, moved, corrected.unionByName(late)]


def view_merge_on_read(spark, sf_dir):
    """Three batches appended as deltas and merged by the reader, with a new base on the way."""
    batches = game_batches(spark, sf_dir)
    table = deltas.KeyedTable(spark, f"{new_root(spark)}/games", batches[0].schema, ["game_id"], ["version"])
    for seq, batch in enumerate(batches):
        table.append(batch, seq)
        table.compact(share=0.4)
    return table.read()


GAME_VERSIONS = """
SELECT game_id, sport, CASE WHEN game_id % 5 <> 0 AND game_id % 3 = 0 THEN game_date + 1 ELSE game_date END AS game_date,
       CASE WHEN game_id % 5 = 0 THEN home_final + 1 ELSE home_final END AS home_final, away_final,
       CASE WHEN game_id % 5 = 0 THEN 3 WHEN game_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM games"""

QUERIES["view_merge_on_read"] = view_merge_on_read
CHECKS["view_merge_on_read"] = check_sql(GAME_VERSIONS)


def refresh_incremental(spark, sf_dir):
    """Games and points by league and day, kept current from the changes of each batch."""
    batches, root = game_batches(spark, sf_dir), new_root(spark)
    table = deltas.KeyedTable(spark, f"{root}/games", batches[0].schema, ["game_id"], ["version"])
    groups = batches[0].select("sport", "game_date").schema
    view = deltas.AdditiveView(spark, f"{root}/by_day", groups, ["home_final", "away_final"])
    for seq, batch in enumerate(batches):
        view.apply(table.changes(batch), seq)
        table.append(batch, seq)
    rows = view.read()
    points = {c: F.col(f"{c}_sum").cast("long") for c in ("home_final", "away_final")}
    return rows.select(
        "sport", "game_date", F.col("n").alias("games"), F.col("home_final_n").alias("finished"),
        points["home_final"].alias("home_points"), points["away_final"].alias("away_points"),
    )


QUERIES["refresh_incremental"] = refresh_incremental
CHECKS["refresh_incremental"] = check_sql(f"""
SELECT sport, game_date, count(*) AS games, count(home_final) AS finished,
       CAST(sum(home_final) AS BIGINT) AS home_points, CAST(sum(away_final) AS BIGINT) AS away_points
FROM ({GAME_VERSIONS}) GROUP BY sport, game_date""")

"""Streaming operators in their batch form, and as streams running to a table (``live_``)."""

import time

from pyspark.sql import functions as F

from matchlens.plans.feed_queries import new_root
from matchlens.plans.slate_queries import AS_OF, AT, OVER
from matchlens.plans.views import check_sql
from matchlens.sources import sinks, tables
from matchlens.streaming import live, state

QUERIES, CHECKS = {}, {}


def stream_latest(spark, sf_dir):
    newest = live.latest(tables.quotes(spark, sf_dir), ["game_id"], ["quote_ts", "quote_id"])
    return newest.select("game_id", "quote_id", "ml_home", "ml_away")


QUERIES["stream_latest"] = stream_latest
CHECKS["stream_latest"] = check_sql("""
SELECT game_id, quote_id, ml_home, ml_away FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY quote_ts DESC, quote_id DESC) AS rn FROM quotes) WHERE rn = 1""")


def stream_dedupe(spark, sf_dir):
    """Quotes that arrive three times, counted once."""
    quotes = tables.quotes(spark, sf_dir)
    copies = quotes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("copy")
    return copies.dropDuplicates(["quote_id"]).select("quote_id", "game_id", "ml_home")


QUERIES["stream_dedupe"] = stream_dedupe
CHECKS["stream_dedupe"] = check_sql("SELECT quote_id, game_id, ml_home FROM quotes")


def stream_tumbling(spark, sf_dir):
    return live.tumbling_counts(tables.events(spark, sf_dir))


QUERIES["stream_tumbling"] = stream_tumbling
CHECKS["stream_tumbling"] = """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events
FROM events GROUP BY ALL"""


def stream_sliding(spark, sf_dir):
    return live.sliding_odds(tables.quotes(spark, sf_dir))


QUERIES["stream_sliding"] = stream_sliding
CHECKS["stream_sliding"] = check_sql("""
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS quotes, min(ml_home) AS low, max(ml_home) AS high,
       arg_max(ml_home, struct_pack(a := quote_ts, b := quote_id)) AS last
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, quote_ts) - INTERVAL 1 MINUTE * (15 * s) AS w
      FROM quotes, (VALUES (0), (1), (2), (3)) v(s))
GROUP BY w""")


def stream_session(spark, sf_dir):
    return live.sessions(tables.events(spark, sf_dir))


QUERIES["stream_session"] = stream_session
CHECKS["stream_session"] = """
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS events
FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
GROUP BY user_id, s"""


def game_expiry(spark, sf_dir):
    return live.expired(tables.games(spark, sf_dir), AS_OF)


QUERIES["game_expiry"] = game_expiry
CHECKS["game_expiry"] = check_sql(f"SELECT game_id, {OVER} AS expired_at FROM games WHERE {OVER} <= {AT}")


def consecutive_failures(spark, sf_dir):
    return live.connectivity(tables.probes(spark, sf_dir)).drop("ts")


QUERIES["consecutive_failures"] = consecutive_failures
CHECKS["consecutive_failures"] = check_sql("""
SELECT user_id, event_id, CAST(fails AS BIGINT) AS fails,
       bool_or(fails >= 2 AND NOT soft_online AND ts >= first_ts + INTERVAL 2500 MILLISECOND)
         OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS down
FROM (SELECT *, sum(CASE WHEN outcome = 'fail' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS fails
      FROM (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island,
                   min(ts) OVER (PARTITION BY user_id) AS first_ts FROM probes))""")


def live_edges(spark, sf_dir):
    scored = live.live_edges(tables.quotes(spark, sf_dir), tables.games(spark, sf_dir))
    return scored.select("quote_id", "game_id", "side", "tier", F.round("edge_pct", 6).alias("edge_pct"))


QUERIES["live_edges"] = live_edges
CHECKS["live_edges"] = check_sql("""
SELECT q.quote_id, q.game_id, side, CASE t6 WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MED' WHEN 1 THEN 'LOW' END AS tier,
       round(edge_pct, 6) AS edge_pct
FROM quotes q JOIN games g ON q.game_id = g.game_id LEFT JOIN edges e ON e.quote_id = q.quote_id""",
    games="quoted",
    quoted="SELECT g.* REPLACE (q.ml_home AS ml_home, q.ml_away AS ml_away), q.quote_id FROM games g JOIN quotes q ON g.game_id = q.game_id")


def freshness(spark, sf_dir):
    """Whether each event, taken as a load, is still fresh at the end of its hour."""
    e = tables.events(spark, sf_dir)
    end = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(1))
    return e.select("event_id", *[live.is_fresh(d, F.col("ts"), end).alias(d) for d in ("schedule", "weather", "adv_nba")])


QUERIES["freshness"] = freshness
CHECKS["freshness"] = """
SELECT event_id, e < ts + INTERVAL 60 SECOND AS schedule, e < ts + INTERVAL 15 MINUTE AS weather, e < ts + INTERVAL 1 HOUR AS adv_nba
FROM (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS e FROM events)"""


def stored_stream(spark, rows, root, time):
    """``rows`` as files that a stream reads; event time is an instant there."""
    rows.write.parquet(f"{root}/feed")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/feed")
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def live_latest(spark, sf_dir):
    """The newest quote of each game, kept in a table by a running stream."""
    root = new_root(spark)
    quotes = stored_stream(spark, tables.quotes(spark, sf_dir), root, "quote_ts")
    keep = sinks.keyed_batches(f"{root}/latest", ["game_id"], ["quote_ts", "quote_id"], buckets=8)
    sinks.finish(quotes.writeStream.foreachBatch(keep), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/latest").select("game_id", "quote_id", "ml_home", "ml_away")


QUERIES["live_latest"] = live_latest
CHECKS["live_latest"] = CHECKS["stream_latest"]


def live_dedupe(spark, sf_dir):
    """Quotes that arrive twice, appended to a table once."""
    root = new_root(spark)
    quotes = tables.quotes(spark, sf_dir)
    stream = stored_stream(spark, quotes.unionByName(quotes), root, "quote_ts")
    once = live.deduplicated_quotes(stream).select("quote_id", "game_id", "ml_home")
    sinks.finish(once.writeStream.format("parquet").option("path", f"{root}/once"), f"{root}/checkpoint")
    return spark.read.schema(once.schema).parquet(f"{root}/once")


QUERIES["live_dedupe"] = live_dedupe
CHECKS["live_dedupe"] = CHECKS["stream_dedupe"]


def live_sessions(spark, sf_dir):
    """Sessions that the watermark has closed, appended to a table as they end."""
    root = new_root(spark)
    events = tables.events(spark, sf_dir).select("user_id", "ts")
    stream = stored_stream(spark, events, root, "ts").withWatermark("ts", live.WATERMARK)
    ended = live.session_counts(stream).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )
    sinks.finish(ended.writeStream.format("parquet").option("path", f"{root}/sessions"), f"{root}/checkpoint")
    return spark.read.schema(ended.schema).parquet(f"{root}/sessions")


QUERIES["live_sessions"] = live_sessions
CHECKS["live_sessions"] = f"""
SELECT * FROM ({CHECKS["stream_session"]})
WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


def finished(stream, root, out):
    """The rows that a stream has appended to a table by its end."""
    sinks.finish(stream.writeStream.format("parquet").option("path", f"{root}/{out}"), f"{root}/checkpoint_{out}")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/{out}")


def closed_windows(windows):
    return windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def live_tumbling(spark, sf_dir):
    """Hours that the watermark has closed."""
    root = new_root(spark)
    events = tables.events(spark, sf_dir).select("ts", "event_type")
    stream = stored_stream(spark, events, root, "ts").withWatermark("ts", live.WATERMARK)
    return closed_windows(finished(live.tumbling_counts(stream), root, "hours"))


QUERIES["live_tumbling"] = live_tumbling
CHECKS["live_tumbling"] = f"""
SELECT * FROM ({CHECKS["stream_tumbling"]}) WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


def live_sliding(spark, sf_dir):
    """Price ranges of the sliding hours that the watermark has closed."""
    root = new_root(spark)
    quotes = tables.quotes(spark, sf_dir).select("quote_id", "quote_ts", "ml_home", "ml_away")
    stream = stored_stream(spark, quotes, root, "quote_ts").withWatermark("quote_ts", live.WATERMARK)
    return closed_windows(finished(live.sliding_odds(stream), root, "ranges"))


QUERIES["live_sliding"] = live_sliding
CHECKS["live_sliding"] = CHECKS["stream_sliding"].rstrip() + """
HAVING w + INTERVAL 1 HOUR <= (SELECT max(quote_ts) - INTERVAL 10 MINUTE FROM quotes)"""


def live_scored(spark, sf_dir):
    """Quotes scored against the model as they arrive."""
    root = new_root(spark)
    quotes = stored_stream(spark, tables.quotes(spark, sf_dir), root, "quote_ts")
    scored = live.live_edges(quotes, tables.games(spark, sf_dir)).select("quote_id", "game_id", "side", "tier", "edge_pct")
    return finished(scored, root, "scored").withColumn("edge_pct", F.round("edge_pct", 6))


QUERIES["live_scored"] = live_scored
CHECKS["live_scored"] = CHECKS["live_edges"]


def live_connectivity(spark, sf_dir):
    """Failures in a row of every probe that the watermark has passed, whatever order probes arrive in."""
    root = new_root(spark)
    probes = tables.probes(spark, sf_dir).select("user_id", "ts", "event_id", "outcome", "soft_online")
    before = state.use_rocksdb(spark)
    try:
        counted = state.connectivity_stream(stored_stream(spark, probes, root, "ts"))
        return finished(counted, root, "counted").drop("ts")
    finally:
        state.use_store(spark, before)


QUERIES["live_connectivity"] = live_connectivity
CHECKS["live_connectivity"] = CHECKS["consecutive_failures"].replace(
    "SELECT user_id, event_id, CAST", "SELECT user_id, event_id, fails, down FROM (SELECT user_id, event_id, ts, CAST", 1
) + """)
WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM probes)"""


def live_forgotten(spark, sf_dir):
    """Each day's loads come twice; days of a dataset with a second to live are new again, others known."""
    root, seconds = new_root(spark), {"odds": 1, "default": 3600}
    dataset = F.when(F.col("event_id") % 2 == 0, "odds").otherwise("weather").alias("dataset")
    loads = tables.events(spark, sf_dir).select(dataset, F.date_format("ts", "yyyy-MM-dd").alias("day"))
    before = state.use_rocksdb(spark)
    try:
        for _ in range(2):
            loads.write.mode("append").parquet(f"{root}/feed")
            stream = spark.readStream.schema(loads.schema).parquet(f"{root}/feed")
            with state.only_with_rows(spark):
                out = finished(state.arrivals(stream, "day", seconds), root, "loads")
            time.sleep(seconds["odds"])
    finally:
        state.use_store(spark, before)
    return out


QUERIES["live_forgotten"] = live_forgotten
CHECKS["live_forgotten"] = """
SELECT dataset, day, came, CASE WHEN dataset = 'odds' THEN came ELSE came * turn END AS loads,
       dataset = 'odds' OR turn = 1 AS is_new
FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'odds' ELSE 'weather' END AS dataset, strftime(ts, '%Y-%m-%d') AS day, count(*) AS came
      FROM events GROUP BY ALL), (VALUES (1), (2)) t(turn)"""


def start_updates(spark, sf_dir):
    """Each game a day before its start; every third one moves, every fifth one later loses its start."""
    games = tables.replayed_starts(tables.games(spark, sf_dir))
    first = games.select("game_id", (F.col("start_ts") - F.expr("INTERVAL 1 DAY")).alias("ts"), "start_ts")
    hour = F.expr("INTERVAL 1 HOUR")
    moved = first.filter("game_id % 3 = 0").withColumns({"ts": F.col("ts") + hour, "start_ts": F.col("start_ts") + hour * 2})
    lost = first.filter("game_id % 5 = 0").withColumns({"ts": F.col("ts") + hour * 3, "start_ts": F.lit(None).cast("timestamp_ntz")})
    return first.unionByName(moved).unionByName(lost)


def live_expiry(spark, sf_dir):
    """Games that a timer has reported as over, appended to a table as event time passes their end."""
    root = new_root(spark)
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', start_ts)")
    updates = start_updates(spark, sf_dir).select("game_id", "ts", millis.alias("start_ms"))
    before = state.use_rocksdb(spark)
    try:
        over = state.expiring_in_buckets(stored_stream(spark, updates, root, "ts"), buckets=32)
        sinks.finish(over.writeStream.format("parquet").option("path", f"{root}/over"), f"{root}/checkpoint")
    finally:
        state.use_store(spark, before)
    at = F.timestamp_millis("expired_ms").cast("timestamp_ntz")
    return spark.read.schema(over.schema).parquet(f"{root}/over").select("game_id", at.alias("expired_at"))


QUERIES["live_expiry"] = live_expiry
CHECKS["live_expiry"] = check_sql("""
SELECT game_id, start_ts + INTERVAL 210 MINUTE AS expired_at
FROM (SELECT game_id, start_ts + CASE WHEN game_id % 3 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS start_ts FROM replayed)
WHERE start_ts + INTERVAL 210 MINUTE <= (SELECT max(start_ts - INTERVAL 1 DAY + CASE WHEN game_id % 5 = 0 THEN INTERVAL 3 HOUR
    WHEN game_id % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) - INTERVAL 10 MINUTE FROM replayed)""")

"""Operators that run on streams, with the batch form they must agree with.

Aggregations are written once and work on both kinds of DataFrame. Late data:
the product states no rule, so the default watermark of ten minutes is ours.
"""

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions.times import game_length, instant
from matchlens.operators.edge import score_edges
from matchlens.skew import in_block, salted_join, sorted_blocks

WATERMARK = "10 minutes"
SESSION_GAP = "30 minutes"

# Failures in a row that count as down, and the grace after start in seconds.
FAILURES = 2
GRACE_SECONDS = 2.5

# Seconds a loaded dataset stays fresh.
FRESHNESS = {
    "schedule": 60, "default": 120, "snapshot": 120, "weather": 900, "team_stats": 1800,
    "player_stats": 1800, "nfl_summary": 1800, "adv_nba": 3600, "adv_mlb": 86400, "adv_nfl": 86400,
}


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; on a stream, run it in update mode.

    An aggregation, so a key with very many updates is reduced before the shuffle.
    """
    payload = [c for c in df.columns if c not in keys and c not in order]
    # The other columns decide between equally new rows.
    ordered = [c for c in orderable(df) if c in payload]
    newest = F.max_by(F.struct(*order, *payload), F.struct(*order, *ordered)).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def orderable(df: DataFrame) -> list[str]:
    """The columns that can be compared: maps and variants have no order."""
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return [name for name, kind in kinds if not any(k in kind for k in ("map<", "variant"))]


def deduplicated_quotes(stream: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Each quote once, as long as its copies arrive within the watermark."""
    return stream.withWatermark("quote_ts", delay).dropDuplicatesWithinWatermark(["quote_id"])


def tumbling_counts(df: DataFrame, width: str = "1 hour") -> DataFrame:
    return _flat(df.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events")))


def sliding_odds(df: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Lowest, highest and last home price per window."""
    last = F.max_by("ml_home", F.struct("quote_ts", "quote_id"))
    return _flat(
        df.groupBy(F.window("quote_ts", width, slide)).agg(
            F.count("*").alias("quotes"),
            F.min("ml_home").alias("low"),
            F.max("ml_home").alias("high"),
            last.alias("last"),
        )
    )


def session_counts(df: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """Events per user session, for streams: state is one open session per user."""
    return _flat(
        df.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")), "session_window"
    )


def sessions(df: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """The same sessions for tables, safe for a user who holds most of the events."""
    keys = ["user_id"]
    ordered = sorted_blocks(df.select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"])
    previous = F.lag("ts").over(in_block(keys))
    pause = F.expr(f"INTERVAL {gap}")
    opens = previous.isNull() | (F.col("ts") >= previous + pause)
    marked = (
        ordered.with_carry(1)
        .withColumn("opens", opens.cast("long"))
        .filter("NOT _carried")
        .drop("_carried")
    )
    numbered = replace(ordered, rows=marked).running(keys, session=("sum", "opens"))
    return numbered.groupBy("user_id", "session").agg(
        F.min("ts").alias("window_start"), (F.max("ts") + pause).alias("window_end"), F.count("*").alias("events")
    ).drop("session")


def _flat(df: DataFrame, name: str = "window") -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(F.col(f"{name}.start").alias("window_start"), F.col(f"{name}.end").alias("window_end"), *rest)


def expired(games: DataFrame, as_of) -> DataFrame:
    """Games whose 3.5 hours have passed, with the moment they did."""
    over = F.col("start_ts") + game_length()
    return games.filter(over <= instant(as_of)).select("game_id", over.alias("expired_at"))


def connectivity(probes: DataFrame) -> DataFrame:
    """Failures in a row and whether the user counts as offline, after each probe.

    A success resets, an abort neither counts nor resets. Going down takes
    ``FAILURES`` failures, the browser's own offline signal and the grace after
    the first probe; it lasts until the next success.
    """
    slim = probes.select("user_id", "ts", "event_id", "outcome", "soft_online")
    flags = slim.withColumns(
        {
            "ok": (F.col("outcome") == "ok").cast("long"),
            "fail": (F.col("outcome") == "fail").cast("long"),
            "neg_ts": F.expr("timestampdiff(MICROSECOND, ts, TIMESTAMP_NTZ '1970-01-01')"),
        }
    )
    ordered = sorted_blocks(flags, ["user_id", "ts", "event_id"])
    # Every success opens an island; probes before the first one share island 0.
    islands = ordered.running(["user_id"], island=("sum", "ok"), neg_first=("max", "neg_ts"))
    counted = replace(ordered, rows=islands).running(["user_id", "island"], fails=("sum", "fail"))
    elapsed = (F.col("neg_first") - F.col("neg_ts")) / 1e6
    trips = (F.col("fails") >= FAILURES) & ~F.col("soft_online") & (elapsed >= GRACE_SECONDS)
    tripped = counted.withColumn("trips", trips)
    state = replace(ordered, rows=tripped).running(["user_id", "island"], down=("max", "trips"))
    return state.select("user_id", "ts", "event_id", "fails", "down")


def is_fresh(dataset: str, loaded_at: Column, as_of) -> Column:
    seconds = FRESHNESS.get(dataset, FRESHNESS["default"])
    return instant(as_of) < loaded_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def refresh_trigger(dataset: str) -> dict[str, str]:
    """Arguments of ``writeStream.trigger`` that keep a dataset fresh."""
    return {"processingTime": f"{FRESHNESS.get(dataset, FRESHNESS['default'])} seconds"}


def live_edges(quotes: DataFrame, games: DataFrame) -> DataFrame:
    """Every quote scored against the model: a stream-static join and no state."""
    rows = games.drop("ml_home", "ml_away")
    keys = ["game_id"]
    if quotes.isStreaming:
        priced = quotes.join(rows, keys)
    else:
        priced = salted_join(quotes, rows, keys, spread=["quote_id"])
    return score_edges(priced)

"""Streams drained with ``availableNow`` agree with the batch form."""

import os
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlens.sources import sinks, tables
from matchlens.streaming import live, state


@pytest.fixture(scope="module")
def event_files(spark, sf_dir, tmp_path_factory):
    """The events as a folder of several files, in time order."""
    path = str(tmp_path_factory.mktemp("events"))
    tables.events(spark, sf_dir).repartitionByRange(4, "ts").write.mode("overwrite").parquet(path)
    # The file source goes by modification time.
    for i, part in enumerate(sorted(Path(path).glob("part-*"))):
        os.utime(part, (1_700_000_000 + i * 60,) * 2)
    return path


@pytest.fixture
def stream(spark, event_files):
    schema = spark.read.parquet(event_files).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(event_files)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(df, mode):
    """Rows of a finished stream."""
    name = "q" + uuid.uuid4().hex[:8]
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return df.sparkSession.table(name)


def as_set(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def stream_quotes(stream):
    """The quote mapping on a stream of events."""
    e = F.col("event_id")
    v = F.floor(F.col("value") * 100).cast("long") % 190
    return stream.select(
        (F.col("user_id") * 7 + e % 7).alias("game_id"),
        F.col("ts").alias("quote_ts"),
        e.alias("quote_id"),
        F.when(e % 2 == 0, -(v + 110)).otherwise(v + 95).cast("double").alias("ml_home"),
        F.when(e % 2 == 0, v + 95).otherwise(-(v + 110)).cast("double").alias("ml_away"),
    )


def test_tumbling(spark, sf_dir, stream):
    got = as_set(drain(live.tumbling_counts(stream), "complete"))
    assert got == as_set(live.tumbling_counts(tables.events(spark, sf_dir)))


def test_sliding(spark, sf_dir, stream):
    got = as_set(drain(live.sliding_odds(stream_quotes(stream)), "complete"))
    assert got == as_set(live.sliding_odds(tables.quotes(spark, sf_dir)))


def test_sessions(spark, sf_dir, stream):
    got = drain(live.session_counts(stream), "complete").select("user_id", "window_start", "window_end", "events")
    batch = live.sessions(tables.events(spark, sf_dir)).select("user_id", "window_start", "window_end", "events")
    assert as_set(got) == as_set(batch)


def test_latest(spark, sf_dir, stream):
    keys, order = ["game_id"], ["quote_ts", "quote_id"]
    got = as_set(drain(live.latest(stream_quotes(stream), keys, order), "complete"))
    assert got == as_set(live.latest(tables.quotes(spark, sf_dir), keys, order))


def test_copies_are_dropped(spark, sf_dir, stream):
    twice = stream_quotes(stream).withColumn("c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("c")
    got = drain(live.deduplicated_quotes(twice), "append")
    assert got.count() == tables.quotes(spark, sf_dir).count() == got.select("quote_id").distinct().count()


def test_live_edges(spark, sf_dir, stream):
    games = tables.games(spark, sf_dir)
    columns = ["quote_id", "game_id", "side", "tier"]
    got = as_set(drain(live.live_edges(stream_quotes(stream), games), "append").select(columns))
    assert got == as_set(live.live_edges(tables.quotes(spark, sf_dir), games).select(columns))


def probes_of(stream):
    kind = F.col("event_type")
    return stream.select(
        "user_id", "ts", "event_id",
        F.when(kind.isin("error", "click"), "fail").when(kind == "signup", "abort").otherwise("ok").alias("outcome"),
        (F.col("event_id") % 3 != 0).alias("soft_online"),
    )


def test_connectivity(spark, sf_dir, stream):
    """Batch after batch, all that the watermark has passed."""
    state.use_rocksdb(spark)
    got = drain(state.connectivity_stream(probes_of(stream)), "append").select("event_id", "fails", "down")
    batch = live.connectivity(tables.probes(spark, sf_dir))
    passed = batch.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTE")).first()[0]
    batch = batch.filter(F.col("ts") <= F.lit(passed)).select("event_id", "fails", "down")
    assert as_set(got) == as_set(batch)
    assert batch.filter("down").count() > 0


def test_connectivity_of_one_user_with_all_rows(spark, sf_dir, stream):
    """Short slices and null signals."""
    state.use_rocksdb(spark)
    one = probes_of(stream).withColumns(
        {"user_id": F.lit(1).cast("long"), "soft_online": F.when(F.col("event_id") % 7 != 0, F.col("soft_online"))}
    )
    got = drain(state.connectivity_stream(one, slice_seconds=60), "append").select("event_id", "fails", "down")
    rows = tables.probes(spark, sf_dir).withColumns(
        {"user_id": F.lit(1).cast("long"), "soft_online": F.when(F.col("event_id") % 7 != 0, F.col("soft_online"))}
    )
    batch = live.connectivity(rows).withColumn("down", F.coalesce("down", F.lit(False)))
    passed = batch.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTE")).first()[0]
    assert as_set(got) == as_set(batch.filter(F.col("ts") <= F.lit(passed)).select("event_id", "fails", "down"))


def test_connectivity_state_goes_by_rows(spark, tmp_path):
    """State entries grow neither with users nor with hours; rows without a user or an id count too."""
    state.use_rocksdb(spark)
    n = F.col("id")
    rows = spark.range(9600).select(
        F.when(n % 401 != 0, n % 401).alias("user_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + n * 9).alias("ts"),
        F.when(n % 13 != 0, n).alias("event_id"),
        F.element_at(
            F.array(*map(F.lit, ["ok", "fail", "fail", "abort"])), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")
        ).alias("outcome"),
        F.when(n % 7 != 0, n % 3 == 0).alias("soft_online"),
    )
    rows.write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "feed"))
    target = str(tmp_path / "out")
    query = (
        state.connectivity_stream(feed, buckets=4).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    entries = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert 0 < max(entries) <= 5 * 8
    columns = ["user_id", "ts", "event_id", "fails", "down"]
    batch = live.connectivity(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    batch = batch.withColumns({"down": F.coalesce("down", F.lit(False)), "ts": F.col("ts").cast("timestamp")})
    passed = batch.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTE")).first()[0]
    assert as_set(spark.read.parquet(target).select(columns)) == as_set(
        batch.filter(F.col("ts") <= F.lit(passed)).select(columns)
    )
    assert batch.filter("down AND user_id IS NULL").count() and batch.filter("event_id IS NULL").count()


def test_pieces_are_merged_and_idle_users_forgotten(spark, tmp_path, monkeypatch):
    """Many small overlapping pieces give the same counts; after an idle hour a user starts anew."""
    monkeypatch.setattr(state, "PIECE_ROWS", 7)
    monkeypatch.setattr(state, "HELD_ROWS", 20)
    entries, values, timers = {}, {}, set()

    class Value:
        def __init__(self, name):
            self.name = name

        exists = lambda self: self.name in values
        get = lambda self: values[self.name]
        update = lambda self, x: values.update({self.name: x})
        clear = lambda self: values.pop(self.name, None)

    class Map:
        getValue = lambda self, k: entries[k]
        updateValue = lambda self, k, v: entries.update({k: v})
        removeKey = lambda self, k: entries.pop(k)
        keys = lambda self: iter(list(entries))

    class Handle:
        getValueState = lambda self, name, schema: Value(name)
        getMapState = lambda self, *a: Map()
        registerTimer = lambda self, at: timers.add(at)
        deleteTimer = lambda self, at: timers.discard(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    counter = state.FailureCounter(idle=3600)
    counter.init(Handle())
    made = np.random.default_rng(1)
    rows = pd.DataFrame({
        "user": made.integers(0, 5, 400), "at": made.integers(0, 60_000_000, 400), "id": np.arange(400),
        "flags": made.choice([1, 2, 6, 0], 400),
    })
    assert not list(counter.handleInputRows((0, False), (rows[i : i + 45] for i in range(0, 400, 45)), None))
    assert len(entries) > 400 / 7
    out = []
    for ms in (20_000, 60_000):
        timers.clear()
        out += list(counter.handleExpiredTimer((0, False), At(ms), At(ms)))
    got = pd.concat(out).sort_values("event_id")
    assert len(got) == 400 and not entries and min(timers) > 3600_000
    kept = {}
    for user, at, ident, flags in sorted(map(tuple, rows.to_numpy().tolist()), key=lambda r: (r[1], r[2])):
        fails, down, first = kept.get(user, (0, False, at))
        fails = 0 if flags & 1 else fails + (flags & 2 > 0)
        down = not flags & 1 and (down or (fails >= 2 and not flags & 4 and at - first >= 2_500_000))
        kept[user] = fails, down, first
        assert tuple(got.iloc[ident][["user_id", "fails", "down"]]) == (user, fails, down)
    assert "state" in values
    list(counter.handleExpiredTimer((0, False), At(4_000_000), At(4_000_000)))
    assert "state" not in values


@pytest.mark.parametrize("form", [state.expiring_games, state.expiring_in_buckets])
def test_game_expiry(spark, sf_dir, stream, form):
    """Timers report exactly the games that ended before the watermark."""
    state.use_rocksdb(spark)
    start = F.unix_millis("ts") - 3 * 3600 * 1000
    updates = stream.select(F.col("event_id").alias("game_id"), start.alias("start_ms"), "ts")
    got = {r["game_id"]: r["expired_ms"] for r in drain(form(updates), "append").collect()}
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    events = tables.events(spark, sf_dir).select("event_id", millis).collect()
    half_hour = 30 * 60 * 1000
    watermark = max(ms for _, ms in events) - 10 * 60 * 1000
    assert got == {g: ms + half_hour for g, ms in events if ms + half_hour <= watermark}
    assert got


@pytest.mark.parametrize("form", [state.expiring_games, lambda df: state.expiring_in_buckets(df, 2)])
def test_expiry_follows_moved_and_lost_starts(spark, tmp_path, form):
    """Batch after batch: a start moves, another gets lost, a third one never was known."""
    state.use_rocksdb(spark)
    hour, day = 3600_000, 24 * 3600_000  # event time starts after the first watermark
    batches = [
        [(1, 0, 0), (2, 0, 0), (3, 0, None), (4, 0, 1)],
        [(1, 1, 9), (2, 1, None)],  # the first game starts nine hours later
        [(9, 6, 100)],  # event time passes the ends of 2 and 4
        [(9, 20, 100)],  # and that of 1
    ]
    feed = str(tmp_path / "feed")
    for i, rows in enumerate(batches):
        rows = [(g, day + at * hour, None if s is None else day + s * hour) for g, at, s in rows]
        df = spark.createDataFrame(rows, "game_id long, at long, start_ms long")
        df.select("game_id", F.timestamp_millis("at").alias("ts"), "start_ms").coalesce(1).write.mode("append").parquet(feed)
        # The file source goes by modification time.
        newest = max(Path(feed).glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + i * 60,) * 2)
    stream = spark.readStream.schema("game_id long, ts timestamp, start_ms long").option("maxFilesPerTrigger", 1).parquet(feed)
    target = str(tmp_path / "over")
    sinks.finish(form(stream).writeStream.format("parquet").option("path", target), str(tmp_path / "checkpoint"))
    got = sorted(tuple(r) for r in spark.read.schema("game_id long, expired_ms long").parquet(target).collect())
    end = day + state.GAME_MILLIS
    assert got == [(1, end + 9 * hour), (2, end), (4, end + hour)]


def test_upsert_keeps_the_newest_row(spark, sf_dir, stream, tmp_path):
    target = str(tmp_path / "state")
    quotes = stream_quotes(stream).withColumn("part", F.col("game_id") % 3)
    run = sinks.upsert_batches(target, ["game_id"], ["quote_ts", "quote_id"], ["part"])
    query = (
        quotes.writeStream.foreachBatch(run)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(target).select("game_id", "quote_id")
    want = live.latest(tables.quotes(spark, sf_dir), ["game_id"], ["quote_ts", "quote_id"]).select("game_id", "quote_id")
    assert as_set(got) == as_set(want)
    before = as_set(got)
    again = spark.read.parquet(target).limit(5)
    sinks.upsert(again, target, ["game_id"], ["quote_ts", "quote_id"], ["part"])
    assert as_set(spark.read.parquet(target).select("game_id", "quote_id")) == before


def test_freshness():
    assert live.refresh_trigger("schedule") == {"processingTime": "60 seconds"}
    assert live.refresh_trigger("unheard of") == {"processingTime": "120 seconds"}

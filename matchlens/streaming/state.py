"""Custom per-key state: game expiry timers, the failure counter, keys that are forgotten in time.

All need the RocksDB state store (``use_rocksdb``). State is a few numbers per
key, and for the failure counter the rows that the watermark has not passed,
packed into pieces of many rows.
"""

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from matchlens.streaming.live import FAILURES, FRESHNESS, GRACE_SECONDS, WATERMARK

# Workers get these classes whole, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GAME_MILLIS = int(3.5 * 3600 * 1000)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> str | None:
    """Keep the state of new streams in RocksDB; returns what was set before."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    return before


def use_store(spark: SparkSession, provider: str | None) -> None:
    if provider is None:
        spark.conf.unset(STORE)
    else:
        spark.conf.set(STORE, provider)


@contextmanager
def only_with_rows(spark: SparkSession):
    """Streams started here run no batch without rows; on processing time such batches would never end."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class GameExpiry(StatefulProcessor):
    """Sets a timer 3.5 hours after each start and reports the game when it fires.

    The newest row with a start counts; a game without any start never expires.
    """

    def __init__(self, event_time: str = "ts"):
        self.event_time = event_time

    def init(self, handle):
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, start = None, None
        for batch in rows:
            # Plain arrays: most games have a row or two.
            starts, times = batch["start_ms"].to_numpy(), batch[self.event_time].to_numpy()
            known = np.flatnonzero(~pd.isna(starts))
            if len(known):
                last = known[times[known].argmax()]
                if newest is None or times[last] >= newest:
                    newest, start = times[last], int(starts[last])
        if start is not None:
            if self.expiry.exists():
                self.handle.deleteTimer(self.expiry.get()[0])
            self.expiry.update((start + GAME_MILLIS,))
            self.handle.registerTimer(start + GAME_MILLIS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expiry.clear()
        yield pd.DataFrame({"game_id": [key[0]], "expired_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self):
        pass


def expiring_games(updates: DataFrame, event_time: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """``(game_id, expired_ms)`` as event time passes each game's end.

    ``updates`` carries ``game_id``, ``start_ms`` (epoch milliseconds) and the event time.
    """
    return (
        updates.withWatermark(event_time, delay)
        .groupBy("game_id")
        .transformWithStateInPandas(
            GameExpiry(event_time), "game_id long, expired_ms long", outputMode="Append", timeMode="EventTime"
        )
    )


class BucketExpiry(StatefulProcessor):
    """``GameExpiry`` for all games of a bucket at once: one state and one timer for many games.

    The state holds the games that are still open, with the event time of their
    newest start and the moment they end; the timer stands at the earliest one.
    """

    def __init__(self, event_time: str = "ts"):
        self.event_time = event_time

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "games array<long>, times array<long>, ends array<long>")
        self.timer = handle.getValueState("timer", "at long")

    def _games(self) -> pd.DataFrame:
        found = self.open.get() if self.open.exists() else ([], [], [])
        return pd.DataFrame(dict(zip(("game_id", "time", "end"), found)), dtype="int64")

    def _keep(self, games: pd.DataFrame) -> None:
        at = int(games["end"].min()) if len(games) else None
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is not None and before != at:
            self.handle.deleteTimer(before)
            self.timer.clear()
        if at is None:
            self.open.clear()
            return
        self.open.update(tuple(games[c].tolist() for c in ("game_id", "time", "end")))
        if before != at:
            self.timer.update((at,))
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [self._games()]
        for batch in rows:
            known = batch.dropna(subset=["start_ms"])
            time = known[self.event_time].astype("datetime64[us]").astype("int64")
            end = known["start_ms"].astype("int64") + GAME_MILLIS
            parts.append(pd.DataFrame({"game_id": known["game_id"], "time": time, "end": end}))
        games = pd.concat(parts, ignore_index=True).sort_values("time", kind="stable")
        self._keep(games.drop_duplicates("game_id", keep="last"))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        games = self._games()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = games["end"] <= now
        # This timer has fired; another one follows for the games that are left.
        self.timer.clear()
        self._keep(games[~over])
        done = games[over]
        yield pd.DataFrame({"game_id": done["game_id"], "expired_ms": done["end"]})

    def close(self):
        pass


def expiring_in_buckets(
    updates: DataFrame, buckets: int = 256, event_time: str = "ts", delay: str = WATERMARK
) -> DataFrame:
    """``expiring_games`` with the games dealt into ``buckets``; choose them for some thousand open games each."""
    bucket = F.pmod(F.xxhash64("game_id"), F.lit(buckets)).cast("int").alias("bucket")
    return (
        updates.withWatermark(event_time, delay)
        .select(bucket, "game_id", "start_ms", event_time)
        .groupBy("bucket")
        .transformWithStateInPandas(
            BucketExpiry(event_time), "game_id long, expired_ms long", outputMode="Append", timeMode="EventTime"
        )
    )


# A probe that waits, and what is known of a user. Flags: 1 ok, 2 failed, 4 online, 8 without an id.
PROBE = np.dtype([("user", "i8"), ("at", "i8"), ("id", "i8"), ("flags", "i1")])
USER = np.dtype([("user", "i8"), ("fails", "i8"), ("down", "?"), ("first", "i8"), ("last", "i8")])
OK, FAILED, ONLINE, NO_ID = 1, 2, 4, 8

# Rows of a stored piece, and rows that are held before they are stored or counted.
PIECE_ROWS, HELD_ROWS = 1 << 14, 1 << 17


class FailureCounter(StatefulProcessor):
    """Counts failures in a row of all users of a bucket, in order of event time; see ``live.connectivity``.

    Probes wait in pieces sorted by event time until the watermark has passed
    them. The pieces are then merged by their first moments and counted, all
    users at once, so a bucket or a user with most of the rows has only the
    pieces in memory that overlap in time. The number of pieces goes by the
    rows, not by users or hours. With ``idle`` seconds, a user who sends nothing
    for so long is forgotten and starts anew. ``slice_seconds`` also cuts pieces
    by event time.
    """

    def __init__(self, idle: int | None = None, slice_seconds: int | None = None):
        self.idle, self.slice = idle, slice_seconds and slice_seconds * 1_000_000

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "users binary")
        self.waiting = handle.getMapState("waiting", "first long, last long, piece long", "rows binary")
        self.stored = handle.getValueState("stored", "pieces long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int | None) -> None:
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is not None and (at is None or at < before):
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        elif before is None or at < before:
            self.timer.update((at,))
            self.handle.registerTimer(at)

    def _wait(self, rows) -> int:
        """Stores rows as pieces; returns the first moment among them."""
        rows = rows[np.argsort(rows["at"], kind="stable")]
        cuts = np.arange(0, len(rows), PIECE_ROWS)
        if self.slice:
            number = rows["at"] // self.slice
            cuts = np.union1d(cuts, np.flatnonzero(number[1:] != number[:-1]) + 1)
        piece = self.stored.get()[0] if self.stored.exists() else 0
        for part in np.split(rows, cuts[1:]):
            self.waiting.updateValue((int(part["at"][0]), int(part["at"][-1]), piece), (part.tobytes(),))
            piece += 1
        self.stored.update((piece,))
        return int(rows["at"][0])

    def _taken(self, key):
        rows = np.frombuffer(self.waiting.getValue(key)[0], dtype=PROBE)
        self.waiting.removeKey(key)
        return rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, size, firsts = [], 0, []
        for batch in rows:
            some = np.empty(len(batch), dtype=PROBE)
            for name in PROBE.names:
                some[name] = batch[name].to_numpy()
            held.append(some)
            size += len(some)
            if size >= HELD_ROWS:
                firsts.append(self._wait(np.concatenate(held)))
                held, size = [], 0
        if size:
            firsts.append(self._wait(np.concatenate(held)))
        if firsts:
            self._wake(-(-min(firsts) // 1000))
        return iter(())

    def _users(self):
        return np.frombuffer(self.state.get()[0] if self.state.exists() else b"", dtype=USER)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.timer.clear()
        pieces = sorted(tuple(k) for k in self.waiting.keys())
        due = [k for k in pieces if k[0] <= now * 1000]
        left = [k[0] for k in pieces[len(due) : len(due) + 1]]
        users, held, place = self._users(), np.empty(0, dtype=PROBE), 0
        while place < len(due):
            parts, size = [held], 0
            while place < len(due) and size < max(HELD_ROWS, len(held)):
                parts.append(self._taken(due[place]))
                size, place = size + len(parts[-1]), place + 1
            rows = np.concatenate(parts)
            # What is not stored any more before this moment is complete.
            end = due[place][0] if place < len(due) else now * 1000 + 1
            passed = rows["at"] < end
            ready, held = rows[passed], rows[~passed]
            if len(ready):
                users, out = counted(users, ready)
                yield out.assign(user_id=None).astype({"user_id": "Int64"}) if key[1] else out
        if len(held):
            left.append(self._wait(held))
        wakes = [-(-at // 1000) for at in left]
        if self.idle is not None and len(users):
            over = users["last"] // 1000 + self.idle * 1000
            gone = over <= now
            wakes += [int(at) for at in np.sort(over[~gone])[:1]]
            if gone.any() and left:
                # Whose probes still wait is not idle; these wake again with them.
                waiting = [self.waiting.getValue(k)[0] for k in [tuple(k) for k in self.waiting.keys()]]
                gone &= ~np.isin(users["user"], np.frombuffer(b"".join(waiting), dtype=PROBE)["user"])
            users = users[~gone]
        if len(users):
            self.state.update((users.tobytes(),))
        else:
            self.state.clear()
        if wakes:
            self._wake(min(wakes))

    def close(self):
        pass


def counted(users, rows):
    """``users`` after ``rows``, and the failures in a row and the verdict after each; scans, no loop."""
    no_id = (rows["flags"] & NO_ID) > 0
    order = np.lexsort((rows["id"], ~no_id, rows["at"], rows["user"]))
    rows, no_id = rows[order], no_id[order]
    who, at, flags, place = rows["user"], rows["at"], rows["flags"], np.arange(len(rows))
    new = np.concatenate([[True], who[1:] != who[:-1]])
    starts, nth = np.flatnonzero(new), np.cumsum(new) - 1
    ends = np.append(starts[1:], len(rows)) - 1
    # What is known of the users of these rows.
    own = np.zeros(len(starts), dtype=USER)
    own["user"], own["first"] = who[starts], at[starts]
    seat = np.searchsorted(users["user"], own["user"])
    known = np.flatnonzero(seat < len(users))
    known = known[users["user"][seat[known]] == own["user"][known]]
    own[known] = users[seat[known]]
    start = starts[nth]
    failed, ok = (flags & FAILED) > 0, (flags & OK) > 0
    total = np.cumsum(failed)
    total += (own["fails"] - (total - failed)[starts])[nth]
    # The last success and the last trip of the user up to each row, or the place before the user's first.
    reset = np.maximum(np.maximum.accumulate(np.where(ok, place, -1)), start - 1)
    none = reset < start
    counts = total - np.where(none, 0, total[reset])
    trips = (counts >= FAILURES) & ((flags & ONLINE) == 0) & ((at - own["first"][nth]) / 1e6 >= GRACE_SECONDS)
    tripped = np.maximum.accumulate(np.where(trips, place, -1))
    downs = (tripped > reset) | (none & own["down"][nth])
    own["fails"], own["down"], own["last"] = counts[ends], downs[ends], at[ends]
    rest = np.delete(users, seat[known])
    users = np.concatenate([rest, own])
    ids = pd.arrays.IntegerArray(rows["id"].copy(), no_id)
    out = pd.DataFrame({"user_id": who, "at": at, "event_id": ids, "fails": counts, "down": downs})
    return users[np.argsort(users["user"], kind="stable")], out


def connectivity_stream(
    probes: DataFrame, delay: str = WATERMARK, idle: int | None = None, slice_seconds: int | None = None, buckets: int = 256
) -> DataFrame:
    """``live.connectivity`` of a stream, in order of event time, as the watermark passes each probe.

    Users are dealt into ``buckets``, each with one state and one timer.
    """
    is_ = lambda c, value: F.coalesce(c, F.lit(False)).cast("int") * value
    flags = (
        is_(F.col("outcome") == "ok", OK) + is_(F.col("outcome") == "fail", FAILED)
        # Without the browser's signal nothing goes down.
        + is_(F.coalesce("soft_online", F.lit(True)), ONLINE) + is_(F.col("event_id").isNull(), NO_ID)
    )
    counted = (
        probes.filter("ts IS NOT NULL")
        .withWatermark("ts", delay)
        .select(
            F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int").alias("bucket"),
            F.col("user_id").isNull().alias("nobody"),
            F.coalesce(F.col("user_id").cast("long"), F.lit(0)).alias("user"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
            F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("id"),
            flags.alias("flags"),
            "ts",
        )
        .groupBy("bucket", "nobody")
        .transformWithStateInPandas(
            FailureCounter(idle, slice_seconds),
            "user_id long, at long, event_id long, fails long, down boolean",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return counted.select("user_id", F.timestamp_micros("at").alias("ts"), "event_id", "fails", "down")


class Arrivals(StatefulProcessor):
    """Counts the rows of a key since it was last new; the state store forgets keys that are no longer fresh."""

    def __init__(self, seconds: dict[str, float], name: str):
        self.seconds, self.name = seconds, name

    def init(self, handle):
        # Each dataset has its own time to live.
        self.seen = {
            dataset: handle.getValueState(f"seen_{dataset}", "loads long", ttlDurationMs=int(seconds * 1000))
            for dataset, seconds in self.seconds.items()
        }

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get(key[0], self.seen["default"])
        before = seen.get()
        came = sum(len(batch) for batch in rows)
        total = came + (before[0] if before else 0)
        # Writing starts the time to live again.
        seen.update((total,))
        yield pd.DataFrame(
            {"dataset": [key[0]], self.name: [key[1]], "came": [came], "loads": [total], "is_new": [before is None]}
        )

    def close(self):
        pass


def arrivals(loads: DataFrame, key: str, seconds: dict[str, float] = FRESHNESS) -> DataFrame:
    """For each batch of a stream and each ``dataset`` and ``key`` in it: rows that ``came``, and ``loads`` in all.

    A key without rows for its dataset's freshness has left the state, so it
    ``is_new`` when it comes again. Time is that of processing, so a stream that
    is to end (``availableNow``) has to be started within ``only_with_rows``.
    """
    slim = loads.select("dataset", key)
    schema = f"dataset string, `{key}` {slim.schema[key].dataType.simpleString()}, came long, loads long, is_new boolean"
    return slim.groupBy("dataset", key).transformWithStateInPandas(
        Arrivals(seconds, key), schema, outputMode="Append", timeMode="ProcessingTime"
    )

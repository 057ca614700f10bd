"""Writing snapshots and keeping views current."""

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.session import written
from matchlens.streaming.live import latest

SNAPSHOT_PARTITIONS = ["sport", "game_date"]
KEY_BUCKET = "key_bucket"
# Up to so many touched partitions are named in the filter of the target's scan.
NAMED_PARTITIONS = 1000


def write_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace exactly the partitions that ``df`` has rows for.

    Rows are first brought together by partition, so that not every task opens
    a file in every folder; ``rebalance`` splits large folders into several tasks.
    """
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    write_partitions(snapshots, path, SNAPSHOT_PARTITIONS)


def refresh_view(view: DataFrame, path: str, partitions: list[str]) -> None:
    """Recompute a materialised view, or the partitions given."""
    write_partitions(view, path, partitions)


def upsert(updates: DataFrame, path: str, keys: list[str], order: list[str], partitions: list[str]) -> None:
    """Keep the newest row per key in a partitioned table.

    Only touched partitions are read and rewritten. Running the same batch
    twice gives the same table. Rows must not move between partitions; where
    they may, ``upsert_keyed`` keeps a table by key.
    """
    spark = updates.sparkSession
    merged = updates
    try:
        current = spark.read.schema(updates.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        merged = touched(current, updates, partitions).unionByName(updates)
    newest = latest(merged, keys, order).select(*updates.columns)
    # Written aside first: the target is also the source.
    write_partitions(written(newest, "upsert"), path, partitions)


def touched(table: DataFrame, updates: DataFrame, partitions: list[str]) -> DataFrame:
    """The rows of ``table`` in the partitions of ``updates``.

    The partitions are named in a filter, so that the scan skips all other
    files; too many to name are joined, with the same result.
    """
    some = updates.select(*partitions).distinct()
    values = some.limit(NAMED_PARTITIONS + 1).collect()
    if len(values) > NAMED_PARTITIONS:
        same = [table[c].eqNullSafe(some[c]) for c in partitions]
        return table.join(some, same, "left_semi")
    one = [reduce(and_, [F.col(c).eqNullSafe(F.lit(row[c])) for c in partitions]) for row in values]
    return table.filter(reduce(or_, one, F.lit(False)))


def upsert_keyed(updates: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 64) -> None:
    """Keep the newest row per key in a table partitioned by a hash of the key.

    A key stays in one folder whatever becomes of its other columns, so a game
    that moves to another day leaves no copy behind. ``buckets`` must stay the
    same for a table; choose it for folders of a few hundred megabytes.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    upsert(updates.withColumn(KEY_BUCKET, bucket), path, keys, order, [KEY_BUCKET])


def upsert_batches(path: str, keys: list[str], order: list[str], partitions: list[str]) -> Callable:
    """The same as a ``foreachBatch`` function."""

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, keys, order, partitions)

    return run


def keyed_batches(path: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable:
    """``upsert_keyed`` as a ``foreachBatch`` function."""

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert_keyed(batch, path, keys, order, buckets)

    return run


def finish(writer, checkpoint: str) -> None:
    """Run a stream over everything that has arrived, then stop.

    Called again with the same checkpoint, it goes on with what arrived since.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

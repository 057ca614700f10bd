"""Helpers shared by the operators of this folder."""

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens import session
from matchlens.session import shared_dir, tune

# Long texts travel to Python in small batches.
BATCH_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """What the operators count on: adaptive plans, small Arrow batches, this package on executors."""
    tune(spark)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        spark.sparkContext.addPyFile(_archive())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


_shipped: set[str] = set()


def _archive() -> str:
    """The package as a zip file, which Spark hands to every executor."""
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    return str(path)


# The folder of the stage that is being built, and those of built stages by their place in the order.
_building: list[str] = []
_built: list[tuple[int, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder, inside a stage in the stage's own, and read back."""
    return session.written(df, "/".join([*_building[-1:], name]))


def stage(place: int, function: Callable) -> Callable:
    """``function(spark, docs, sf_dir)`` as the stage with that place, its intermediates in one folder.

    The output of a stage is written before the next one reads it, so a stage
    removes the folders of earlier ones, but none that its own input reads from.
    """

    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        removed(ready(spark), docs, place)
        folder = f"{function.__name__}-{uuid.uuid4().hex}"
        _built.append((place, folder))
        _building.append(folder)
        try:
            return function(spark, docs, sf_dir)
        finally:
            _building.pop()

    return staged


def removed(spark: SparkSession, docs: DataFrame, place: int) -> None:
    """Delete the folders of the stages before ``place``, except those that ``docs`` reads from."""
    if not any(at < place for at, _ in _built):
        return
    read = docs.inputFiles()
    for at, folder in list(_built):
        if at < place and not any(f"/{folder}/" in file for file in read):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{folder}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _built.remove((at, folder))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def added(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``; input columns of the same name give way, in any case."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def at_most(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """The most frequent rows, ``limit`` at most, without a sort.

    A histogram of the counts on a logarithmic scale (some hundred rows) gives
    the smallest count that still fits; rows of one step of the scale stay or
    go together, so the choice does not depend on the order of the rows.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    total, least = 0, None
    for row in sorted(steps, key=lambda r: -r["step"]):
        total += row["n"]
        if total > limit:
            break
        least = row["step"]
    if least is None:
        return counts.limit(0)
    return counts.filter(step >= least)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Rows with ``_part`` and ``_nth``: their place among the rows of ``key`` in their task.

    No row moves, so one key may hold all rows. The result has to be written
    before it is read twice, as a new run may deal rows to other tasks.
    """
    schema = f"{_ddl(df)}, _part long, _nth long"

    def number(frames):
        from pyspark import TaskContext

        released()
        part, seen = TaskContext.get().partitionId(), {}
        for frame in frames:
            nth = frame.groupby(key, sort=False, dropna=False).cumcount()
            start = frame[key].map(seen).fillna(0).astype("int64")
            yield frame.assign(_part=part, _nth=(nth + start).astype("int64"))
            for k, n in frame[key].value_counts().items():
                seen[k] = seen.get(k, 0) + int(n)

    return df.mapInPandas(number, schema)


def ranked(df: DataFrame, key: str, out: str) -> DataFrame:
    """Gapless positions from 0 within each ``key``, however many rows a key holds.

    Rows are numbered where they lie; what the earlier tasks hold of a key comes
    from a table with one row for each key and task.
    """
    rows = written(numbered(df, key), "numbered")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(key, "_part")
        .agg(F.count("*").alias("_n"))
        .select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return rows.join(starts, [key, "_part"]).withColumn(out, F.col("_before") + F.col("_nth")).drop(
        "_part", "_nth", "_before"
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def held_out(doc_id: str, folds: int, fold: int):
    """Whether the row belongs to the given fold by its id; rows without an id do not."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(False))


_held: dict = {}


def held(key, make):
    """What ``make`` gives, kept in this Python process until another operator needs its place.

    Workers serve one operator after another; only the latest keeps its tables.
    """
    if key not in _held:
        _held.clear()
        trimmed()
        _held[key] = make()
        trimmed()
    return _held[key]


def released() -> None:
    """Let go of what an earlier operator left in this Python process; for operators without tables of their own."""
    if _held:
        _held.clear()
        trimmed()


def trimmed() -> None:
    """Give memory that Python and Arrow hold without need back to the system, where it can be asked for."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)

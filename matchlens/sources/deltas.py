"""A keyed table that grows by deltas, and aggregate views kept current from its changes.

A batch only appends its rows under its sequence number; no stored file is read
or rewritten. Readers merge: the newest row of each key among the base and the
deltas after it. Once the deltas hold more than a given share of the base's
rows, ``compact`` writes a new base. A base counts from the moment it stands in
the table's log, so a job that dies on the way changes nothing for readers, and
a batch that is run again replaces its own delta.

An additive view keeps counts and sums by group. A batch adds what its changes
add: every old row taken away, every new one put in. Rows that move to another
group are thereby taken out of their old one.
"""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlens.streaming.live import latest, orderable

SEQUENCE = "delta_seq"
COMPACT_AT = 0.5


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet files under ``path``; none if it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class _Log:
    """Rows in ``deltas/delta_seq=n`` after the newest base that the log names."""

    spark: SparkSession
    path: str
    schema: StructType

    def append(self, rows: DataFrame, seq: int) -> None:
        """Store a batch; the same number again replaces it. Nothing stored is read."""
        columns = [f.name for f in self.schema.fields]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/deltas/{SEQUENCE}={seq}")

    def upto(self) -> int:
        """The last batch that the newest base holds; -1 without a base."""
        log = _stored(self.spark, f"{self.path}/log", StructType().add("upto", "long"))
        return log.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def base(self, upto: int) -> DataFrame:
        return _stored(self.spark, f"{self.path}/base-{upto}", self.schema)

    def deltas(self, upto: int) -> DataFrame:
        """Batches after the base; older folders are skipped by their number."""
        schema = StructType([*self.schema.fields]).add(SEQUENCE, "long")
        return _stored(self.spark, f"{self.path}/deltas", schema).filter(F.col(SEQUENCE) > upto)

    def rebase(self, merged: DataFrame, last: int) -> None:
        merged.write.mode("overwrite").parquet(f"{self.path}/base-{last}")
        entry = self.spark.range(1).select(F.lit(last).cast("long").alias("upto"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def due(self, upto: int, share: float) -> int | None:
        """The last batch to merge, if the deltas hold more than ``share`` of the base's rows."""
        deltas = self.deltas(upto).agg(F.count("*").alias("n"), F.max(SEQUENCE).alias("last")).first()
        return deltas["last"] if deltas["n"] > share * self.base(upto).count() else None


@dataclass(frozen=True)
class KeyedTable:
    """The newest row of each key; ``order`` ranks the rows of one key.

    Of rows that ``order`` does not tell apart the one with the greatest other columns counts.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: list[str]
    order: list[str]

    @property
    def _log(self) -> _Log:
        return _Log(self.spark, self.path, self.schema)

    def append(self, updates: DataFrame, seq: int) -> None:
        self._log.append(updates, seq)

    def _merged(self, upto: int) -> DataFrame:
        rows = self._log.base(upto).unionByName(self._log.deltas(upto).drop(SEQUENCE))
        return latest(rows, self.keys, self.order).select(*self.schema.names)

    def read(self) -> DataFrame:
        """The table as it stands: base and deltas merged."""
        return self._merged(self._log.upto())

    def compact(self, share: float = COMPACT_AT) -> bool:
        """Merge the deltas into a new base if they hold more than ``share`` of its rows."""
        upto = self._log.upto()
        last = self._log.due(upto, share)
        if last is not None:
            self._log.rebase(self._merged(upto), last)
        return last is not None

    def changes(self, updates: DataFrame) -> DataFrame:
        """What ``updates`` would change: old rows with ``sign`` -1, new ones with 1.

        Updates that are not newer than the stored row change nothing. Take the
        changes before the batch is appended; only keys of the batch are looked up.
        """
        new = latest(updates.select(*self.schema.names), self.keys, self.order)
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in self.keys]
        upto = self._log.upto()
        rows = self._log.base(upto).unionByName(self._log.deltas(upto).drop(SEQUENCE))
        asked = new.select(*self.keys)
        # The stored rows of these keys only, before they are merged.
        old = latest(rows.join(asked, same(rows, asked), "left_semi"), self.keys, self.order)
        payload = [c for c in self.schema.names if c not in self.keys]
        box = lambda df, name: df.select(*self.keys, F.struct(*payload).alias(name))
        both = box(new, "new").join(box(old, "old").withColumnsRenamed({k: f"old_{k}" for k in self.keys}), [
            F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in self.keys
        ], "left")
        ranked = [*self.order, *[c for c in orderable(new) if c in payload and c not in self.order]]
        rank = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in ranked])
        newer = both.filter(F.col("old").isNull() | (rank("new") > rank("old")))
        signed = F.array(
            F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")),
            F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")),
        )
        flat = newer.select(*self.keys, F.explode(signed).alias("c")).filter("c.row IS NOT NULL")
        return flat.select(*self.keys, "c.row.*", "c.sign").select(*self.schema.names, "sign")

    def batches(self, share: float = COMPACT_AT):
        """The table as a ``foreachBatch`` function."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id)
            self.compact(share)

        return run


@dataclass(frozen=True)
class AdditiveView:
    """``groups`` with the number of rows ``n`` and, for each of ``sums``, its sum and how many rows have it."""

    spark: SparkSession
    path: str
    groups: StructType
    sums: list[str]

    @property
    def _log(self) -> _Log:
        schema = StructType([*self.groups.fields]).add("n", "long")
        for name in self.sums:
            schema = schema.add(f"{name}_sum", "decimal(38,6)").add(f"{name}_n", "long")
        return _Log(self.spark, self.path, schema)

    def apply(self, changes: DataFrame, seq: int) -> None:
        """Store what a change set adds to each group; the same number again replaces it."""
        value = lambda c: F.col(c).cast("decimal(28,6)") * F.col("sign")
        held = lambda c: F.when(F.col(c).isNotNull(), F.col("sign"))
        added = [F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n")]
        for c in self.sums:
            added.append(F.coalesce(F.sum(value(c)), F.lit(0)).cast("decimal(38,6)").alias(f"{c}_sum"))
            added.append(F.coalesce(F.sum(held(c)), F.lit(0)).cast("long").alias(f"{c}_n"))
        self._log.append(changes.groupBy(*self.groups.names).agg(*added), seq)

    def _merged(self, upto: int) -> DataFrame:
        schema = self._log.schema
        rows = self._log.base(upto).unionByName(self._log.deltas(upto).drop(SEQUENCE))
        names = [c for c in schema.names if c not in self.groups.names]
        summed = rows.groupBy(*self.groups.names).agg(*[F.sum(c).cast(schema[c].dataType).alias(c) for c in names])
        return summed.filter("n <> 0")

    def read(self) -> DataFrame:
        """Groups that have rows; the sum of a column that no row has is null."""
        rows = self._merged(self._log.upto())
        totals = [F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sum")).alias(f"{c}_sum") for c in self.sums]
        return rows.select(*self.groups.names, "n", *totals, *[f"{c}_n" for c in self.sums])

    def compact(self, share: float = COMPACT_AT) -> bool:
        upto = self._log.upto()
        last = self._log.due(upto, share)
        if last is not None:
            self._log.rebase(self._merged(upto), last)
        return last is not None

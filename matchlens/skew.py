"""Ordered and keyed work that stays even when one key holds most of the rows.

*Ordered work* (positions, look-backs, running totals) sorts the rows globally
by ``(key, order)``. Spark's range partitioner cuts that order into even
blocks, also through the middle of a hot key. Each block is then worked on
alone and receives what it needs from earlier blocks: a few carried-in rows,
or one prefix per key. Those additions are bounded by the number of blocks.

*Keyed joins* spread the rows of hot keys over salts. Hot keys come from a
one-pass frequent-items sketch and number at most ``1 / share``.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.session import written

HOT_SHARE = 1e-3
HOT_MIN_ROWS = 1_000_000
MERGERS = 256


@dataclass
class Blocks:
    """Rows in global order: ``_pos`` is the 0-based position, ``_block`` the sorted block."""

    rows: DataFrame
    bounds: DataFrame  # _block, _first, _last; one row per block
    count: int

    def with_carry(self, depth: int) -> DataFrame:
        """Rows plus the ``depth`` rows before each block, flagged ``_carried``.

        Inside a block, any look-back of at most ``depth`` rows is then complete.
        """
        own = self.rows.withColumn("_carried", F.lit(False))
        if self.count < 2:
            return own
        wanted = self.bounds.filter("_first > 0").select(
            F.col("_block").alias("_target"),
            F.explode(
                F.sequence(F.greatest(F.col("_first") - depth, F.lit(0)), F.col("_first") - 1)
            ).alias("_pos"),
        )
        carried = (
            self.rows.join(F.broadcast(wanted), "_pos")
            .withColumn("_block", F.col("_target"))
            .withColumn("_carried", F.lit(True))
            .drop("_target")
        )
        return own.unionByName(carried)

    def running(self, keys: list[str], inclusive: bool = True, **aggs) -> DataFrame:
        """Adds running ``sum`` or ``max`` columns per key, in block order.

        ``aggs`` maps a new column to ``("sum" | "max", column)``. The rows of
        a key must be contiguous in the global order.
        """
        upto = 0 if inclusive else -1
        inside = (
            Window.partitionBy(*keys, "_block")
            .orderBy("_pos")
            .rowsBetween(Window.unboundedPreceding, upto)
        )
        call = {"sum": F.sum, "max": F.max}
        out = self.rows.withColumns({n: call[f](c).over(inside) for n, (f, c) in aggs.items()})
        if self.count > 1:
            out = self._add_prefixes(out, keys, aggs, call)
        return out.withColumns(
            {n: F.coalesce(n, F.lit(0)) for n, (f, _) in aggs.items() if f == "sum"}
        )

    def _add_prefixes(self, out, keys, aggs, call) -> DataFrame:
        # Only fragments touching a block edge continue elsewhere: at most two per block.
        fragments = (
            self.rows.groupBy(*keys, "_block")
            .agg(
                F.min("_pos").alias("_lo"),
                F.max("_pos").alias("_hi"),
                *[call[f](c).alias(n) for n, (f, c) in aggs.items()],
            )
            .join(F.broadcast(self.bounds), "_block")
            .filter("_lo = _first OR _hi = _last")
        )
        earlier = (
            Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        )
        prefixes = fragments.select(
            *keys, "_block", *[call[f](n).over(earlier).alias(f"_before_{n}") for n, (f, _) in aggs.items()]
        ).filter(" OR ".join(f"_before_{n} IS NOT NULL" for n in aggs))
        out = out.join(F.broadcast(prefixes), [*keys, "_block"], "left")
        for n, (f, _) in aggs.items():
            before = F.col(f"_before_{n}")
            if f == "sum":
                both = F.coalesce(F.col(n), F.lit(0)) + F.coalesce(before, F.lit(0))
            else:
                both = F.greatest(F.col(n), before)
            out = out.withColumn(n, both).drop(f"_before_{n}")
        return out


def sorted_blocks(df: DataFrame, order: list) -> Blocks:
    """Sort globally and fix the result as a table; ``order`` must be a total order."""
    stamped = written(
        df.orderBy(*order).withColumn("_gid", F.monotonically_increasing_id()), "blocks"
    )
    block, local = F.shiftright("_gid", 33), F.col("_gid").bitwiseAND((1 << 33) - 1)
    # One row per sorted block, that is per shuffle partition.
    sizes = stamped.groupBy(block.alias("b")).count().orderBy("b").collect()
    bounds, first = [], 0
    for b, n in sizes:
        bounds.append((b, first, first + n - 1))
        first += n
    spark = df.sparkSession
    bounds_df = spark.createDataFrame(bounds, "_block long, _first long, _last long")
    rows = (
        stamped.withColumn("_block", block)
        .join(F.broadcast(bounds_df), "_block")
        .withColumn("_pos", F.col("_first") + local)
        .drop("_gid", "_first", "_last")
    )
    return Blocks(rows, bounds_df, len(bounds))


def in_block(keys: list[str]) -> Window:
    """Window over the rows of one key inside one block."""
    return Window.partitionBy(*keys, "_block").orderBy("_pos")


def positions(df: DataFrame, group: list[str], order: list, name: str = "position") -> DataFrame:
    """1-based position inside each group, without putting a group into one task."""
    blocks = sorted_blocks(df, [*group, *order])
    ranked = blocks.running(group, **{name: ("sum", F.lit(1).cast("long"))})
    return ranked.drop("_block", "_pos")


def hot_keys(df: DataFrame, keys: list[str], share: float, min_rows: int) -> list[tuple[int, int]]:
    """``(hash, salts)`` of the keys holding more than ``share`` of the rows.

    One scan of the key columns. Sketches of a fixed size are merged in two
    steps, so that the last task sees a few hundred of them however many tasks
    scan; at most ``1 / share`` keys can pass the threshold.
    """
    top = int(1 / share)
    tracked = 8 * top
    hashed = df.select(F.xxhash64(*keys).alias("h"), (F.spark_partition_id() % MERGERS).alias("g"))
    partial = hashed.groupBy("g").agg(
        F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("s"), F.count("*").alias("n")
    )
    # Grouped by a constant: combining fails on tasks without input otherwise.
    merged = partial.groupBy(F.lit("all")).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {top})").alias("found"),
        F.sum("n").alias("total"),
    )
    row = merged.first()
    if row is None:
        return []
    found, total = row["found"], row["total"]
    limit = max(total * share, min_rows)
    return [(r["item"], -(-r["count"] // int(limit))) for r in found if r["count"] > limit]


def salted_join(
    facts: DataFrame,
    dims: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """Join many ``facts`` per key to few ``dims`` per key, salting hot keys.

    ``spread`` are columns that tell the facts of one key apart. Keys that are
    not hot are joined as usual; every match is kept. Where ``facts`` are
    costly, ``sketch`` names cheaper rows to look for hot keys in: a wrong
    guess changes the number of salts, never the result.
    """
    if how not in ("inner", "left"):
        raise ValueError("repeated dimension rows allow only inner and left joins")
    hot = hot_keys(facts if sketch is None else sketch, keys, share, min_rows)
    if not hot:
        return facts.join(dims, keys, how)
    salts = F.broadcast(facts.sparkSession.createDataFrame(hot, "_h long, _salts long"))

    def with_salts(df):
        df = df.withColumn("_h", F.xxhash64(*keys)).join(salts, "_h", "left")
        return df.withColumn("_salts", F.coalesce("_salts", F.lit(1).cast("long")))

    left = with_salts(facts).withColumn("_salt", F.pmod(F.xxhash64(*spread), F.col("_salts")))
    right = with_salts(dims).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))
    )
    joined = left.drop("_h", "_salts").join(right.drop("_h", "_salts"), [*keys, "_salt"], how)
    return joined.drop("_salt")

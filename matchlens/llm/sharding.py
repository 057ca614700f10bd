"""Shards balanced in bytes, tokens and rows by vector bin packing.

Rows with equal texts form a group and stay together as long as the group is
small next to a shard. Each group has a size in three dimensions. Groups that
stand out are items of their own, the others are dealt by their hash into a
fixed number of small items, so that planning sees a bounded table however many
groups there are. Items are placed from the largest on, each in the shard where
the dot product of its size with what the shard still lacks is highest, among
those that still have room for it.

A group larger than a quarter of a shard is split by row before placing; its
parts are dealt by a hash of the row's id and its place in its task.

Null texts count as empty and have size 1. Rows without an id are placed like
others. Extra columns stay; those named like a result give way.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added, numbered, ranked, written

SMALL_ITEMS = 4096
SPLIT_SHARE = 4
SPACE = r"[\x20\x09-\x0D]+"


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its sizes, checksum and group."""
    content = F.coalesce(F.col(text), F.lit(""))
    return added(
        docs,
        {
            "size": (F.octet_length(content) + 1).cast("long"),
            "text_crc32": F.crc32(content.cast("binary")),
            "_tokens": F.size(F.array_remove(F.split(content, SPACE), "")).cast("long"),
            "_group": F.xxhash64(content),
        },
    ).drop(text)


def items(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``_item``: its own for a large group, split if very large, else a small one."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("_group").agg(F.sum("size").alias("bytes"))
    # Fewer than SMALL_ITEMS groups can be larger than the mean small item.
    large = groups.filter(F.col("bytes") * SMALL_ITEMS > total)
    parts = F.ceil(F.col("bytes") * (shards * SPLIT_SHARE) / F.lit(max(total, 1))).cast("long")
    large = written(large.select("_group", parts.alias("_parts")), "large_groups")
    part = F.pmod(F.xxhash64("_part", "_nth"), F.col("_parts"))
    return added(
        rows.join(F.broadcast(large), "_group", "left"),
        {
            "_item": F.when(
                F.col("_parts").isNotNull(),
                F.concat_ws("/", F.lit("large"), F.col("_group"), part),
            ).otherwise(F.concat_ws("/", F.lit("small"), F.pmod(F.col("_group"), F.lit(SMALL_ITEMS))))
        },
    ).drop("_parts")


def placed(sizes: list[tuple], shards: int) -> dict[str, int]:
    """Shard of each item; ``sizes`` are ``(item, bytes, tokens, rows)``."""
    import numpy as np

    if not sizes:
        return {}
    names = [s[0] for s in sizes]
    size = np.array([s[1:] for s in sizes], dtype=np.float64)
    size /= np.maximum(size.sum(0), 1) / shards  # a shard's fair share is 1 in each dimension
    residual = np.ones((shards, size.shape[1]))
    out = {}
    for k in sorted(range(len(names)), key=lambda k: (-size[k].max(), names[k])):
        after = residual - size[k]
        scores = residual @ size[k]
        room = after.min(1) >= 0
        if not room.any():  # none has room in all dimensions: the one that lacks most bytes
            scores, room = after[:, 0], np.ones(shards, dtype=bool)
        best = int(np.argmax(np.where(room, scores, -np.inf)))
        residual[best] -= size[k]
        out[names[k]] = best
    return out


def sharded(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``size, text_crc32, shard`` and ``slot`` (gapless in the shard)."""
    rows = sized(docs, text)
    rows = written(numbered(added(rows, {"_all": F.lit(0)}), "_all"), "sized").drop("_all")
    rows = items(rows, shards)
    sums = rows.groupBy("_item").agg(
        F.sum("size").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")
    )
    # At most SMALL_ITEMS small items, as many large groups, and SPLIT_SHARE * shards parts.
    plan = placed([tuple(r) for r in sums.collect()], shards)
    spark = docs.sparkSession
    where = spark.createDataFrame(list(plan.items()), "_item string, shard int")
    rows = rows.join(F.broadcast(where), "_item")
    return ranked(rows.drop("_item", "_group", "_tokens", "_part", "_nth"), "shard", "slot")

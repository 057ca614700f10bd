"""Near copies by SimHash and minimum hashes, held to the true similarity of their sets of word shingles.

Two texts are near copies if the Jaccard similarity of their sets of
``WIDTH``-word shingles is at least ``SIMILARITY``; near copies of near copies
go together. Texts with equal sets are one node. Candidates come from two
indexes over the same shingles. One is that of operator 3 (``simhash``): three
segments of the SimHash fingerprint, each with one bit blotted out, met by an
equality shuffle and verified by the true distance, find every pair at ``BITS``
or fewer differing bits. As many pairs of that similarity differ in more bits,
minimum hashes find those: ``BANDS`` entries of ``ROWS`` hashes each. A pair at
the least similarity shares none of them once in twenty thousand times
(``(1 - 0.8 ** 5) ** 25``), a more similar one still more seldom. Every entry
ties its nodes to one of them, so the ties grow with the members, not with their
pairs. The groups they form are only candidates: inside each the similarities
are worked out from the texts, and the links found so give the components.
Groups too long for one task are cut into blocks, and every two blocks meet in
a task of their own.

Texts below the width are one shingle. Null and wordless texts are copies of
each other. Rows without an id take part. Repeated rows stay. Extra columns stay.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm import simhash
from matchlens.llm.common import added, released, written
from matchlens.llm.graph import components

WIDTH, SIMILARITY = 5, 0.8
BITS = 4
ROWS, BANDS = 5, 25
SEED = 42
BLOCK_CHARS = 4 << 20
SHINGLES_AT_ONCE = 1 << 13


def shingles(text: str | None, width: int = WIDTH):
    """Sorted distinct hashes of all runs of ``width`` lower-cased words."""
    return _distinct(list(simhash.hashed_runs(text, width)))


def _distinct(runs: list):
    import numpy as np

    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *runs]))


def _multipliers():
    import numpy as np

    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS), dtype=np.uint64)
    return draw * np.uint64(2) + np.uint64(1)


def bands(found, multipliers):
    """One integer for each band of minimum hashes; none for an empty set."""
    import numpy as np

    if not len(found):
        return np.empty(0, dtype=np.uint64)
    by, mixed = multipliers
    least = np.full(len(by), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        least = np.minimum(least, (found[at : at + SHINGLES_AT_ONCE, None] * by).min(axis=0))
    least ^= least >> np.uint64(32)
    return (least * mixed).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def with_bands(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_node``, a hash of the set of shingles, ``_fp``, their SimHash fingerprint, and ``_bands``."""

    @F.pandas_udf("struct<node:long,fp:long,bands:array<long>>")
    def found(texts):
        import numpy as np
        import pandas as pd
        import xxhash

        released()
        by, nodes, prints, keys = _multipliers(), [], [], []
        for t in texts:
            runs = list(simhash.hashed_runs(t, WIDTH))
            some = _distinct(runs)
            nodes.append(xxhash.xxh64_intdigest(some.tobytes(), SEED))
            prints.append(simhash.majority(runs))
            keys.append(bands(some, by).view(np.int64))
        signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"node": signed(nodes), "fp": signed(prints), "bands": keys})

    rows = docs.withColumn("_found", found(F.col(text)))
    return added(rows, {f"_{c}": F.col(f"_found.{c}") for c in ("node", "fp", "bands")}).drop("_found")


def forest(sets: list, least: float = SIMILARITY):
    """Pairs of places whose links span the components of the sets at least that similar."""
    import numpy as np

    sizes = np.array(list(map(len, sets)), dtype=np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # Which sets hold a shingle.
    order = np.argsort(ids, kind="stable")
    holders, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])
    unseen, pairs = np.ones(len(sets), dtype=bool), []
    for seed in range(len(sets)):
        front = [seed] if unseen[seed] else []
        unseen[seed] = False
        while front:
            one = front.pop()
            mine = ids[starts[one] : starts[one + 1]]
            met = np.concatenate([holders[first[i] : first[i + 1]] for i in mine]) if len(mine) else mine
            places, shared = np.unique(met[unseen[met]], return_counts=True)
            near = places[shared / (sizes[one] + sizes[places] - shared) >= least]
            unseen[near] = False
            pairs += [(one, other) for other in near.tolist()]
            front += near.tolist()
    return pairs


def _linked(frame):
    """True links among the members of a group, or of two blocks of one."""
    import pandas as pd

    released()
    nodes = frame["node"].to_numpy()
    pairs = forest([shingles(t) for t in frame["text"]]) if len(nodes) > 1 else []
    return pd.DataFrame(
        {"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}, dtype="int64"
    )


def ties(nodes: DataFrame) -> DataFrame:
    """``a, b``: each ``_node`` of an entry with the smallest one there."""
    entries = nodes.select("_node", F.posexplode("_bands").alias("band", "key"))
    hubs = entries.groupBy("band", "key").agg(F.min("_node").alias("hub"), F.max("_node").alias("last"))
    met = entries.join(hubs.filter("hub <> last"), ["band", "key"])
    return met.filter("_node <> hub").select(F.col("_node").alias("a"), F.col("hub").alias("b")).distinct()


def alike(prints: DataFrame) -> DataFrame:
    """``a, b``: nodes tied by fingerprints of at most ``BITS`` differing bits, from rows ``_node, _fp``.

    The nodes of one fingerprint hang on the smallest; the links between fingerprints tie those.
    """
    prints = written(prints.distinct(), "prints")
    hubs = prints.groupBy("_fp").agg(F.min("_node").alias("hub"))
    same = prints.join(hubs, "_fp").select(F.col("_node").alias("a"), F.col("hub").alias("b")).filter("a <> b")
    near = simhash.links(hubs.select(F.col("_fp").alias("fp")), BITS)
    of = lambda end: hubs.select(F.col("_fp").alias(end), F.col("hub").alias(f"of_{end}"))
    met = near.join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(met.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))


def links(members: DataFrame, block: int = BLOCK_CHARS) -> DataFrame:
    """``a, b``: the links inside the candidate groups ``root`` of ``node, text``."""
    sizes = members.groupBy("root").agg(F.ceil(F.sum(F.length("text")) / block).alias("n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    paired = (
        members.join(sizes, "root")
        .withColumn("m", F.pmod(F.xxhash64("node"), F.col("n")))
        .select("root", "node", "text", "m", other.alias("o"))
        .select("root", "node", "text", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"))
    )
    # Dealt by all three, so the blocks of one group do not share a task.
    return paired.repartition("root", "i", "j").groupBy("root", "i", "j").applyInPandas(_linked, "a long, b long")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without all but one row of each component: one with the smallest id stays."""
    columns = docs.columns
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(text).alias("_text")
    ).withColumn("_row", F.monotonically_increasing_id())
    rows = written(with_bands(boxed, "_text").drop("_text"), "shingled")
    ident, content = F.col(f"_doc.`{doc_id}`"), F.col(f"_doc.`{text}`")
    # Ids before nulls, then the row: unique even if ids repeat.
    head = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col("_row").alias("row"))
    nodes = rows.groupBy("_node").agg(F.min(head).alias("head"), F.first("_bands").alias("_bands"))
    proposed = alike(rows.select("_node", "_fp")).unionByName(ties(nodes))
    groups = components(proposed).select(F.col("node").alias("_node"), "root")
    # The text of one row speaks for its node.
    heads = written(nodes.select("_node", "head"), "nodes")
    asked = written(
        heads.join(groups, "_node").select(F.col("head.row").alias("_row"), F.col("_node").alias("node"), "root"),
        "candidates",
    )
    members = rows.select("_row", content.alias("text")).join(asked, "_row")
    roots = components(links(members, block)).withColumnRenamed("node", "_node")
    placed = heads.join(roots, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    firsts = placed.groupBy("root").agg(F.min("head").alias("first"))
    kept = placed.join(firsts, "root").select("_node", F.col("first.row").alias("_first"))
    gone = rows.select("_row", "_node").join(kept, "_node").filter("_row <> _first").select("_row")
    # Written, its size is known, and a small table does not make the texts move.
    left = rows.join(written(gone, "copies"), "_row", "left_anti")
    return left.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns])

"""Near duplicates by SimHash, found through deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that, of two fingerprints
at the allowed distance, one segment differs in at most one bit: three for four
bits. Each segment is indexed once for every bit with that bit blotted out, so
two such fingerprints share an index entry. Entries are met by an equality
shuffle and every pair in one is verified by its true distance.

Equal fingerprints are one node. Short entries link each pair in the first
entry it shares; long ones give a spanning forest, which keeps the components
and grows with the members, not their pairs. Entries too long for one task are
cut into blocks, and every two blocks meet in a task of their own.

Null and wordless texts have fingerprint zero. Rows without an id take part;
a component's id is its smallest id, or null if none of its rows has one.
Repeated rows stay. Extra columns stay; those named like a result give way.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added, released, written
from matchlens.llm.graph import components

SEED = 42
BITS = 64
ALL_PAIRS = 512
BLOCK = 8192
SHINGLES_AT_ONCE = 1 << 16


def hashed_runs(text: str | None, width: int):
    """The hashes of all runs of ``width`` lower-cased words, repeats included, some at a time."""
    import numpy as np
    import xxhash

    # Bytes know just these letters and just this white space.
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.array(list(map(len, words))) + 1).tolist()
    starts = [0, *ends[:-1]]
    stops = [e - 1 for e in ends[width - 1 :]] or [len(joined)]
    for at in range(0, len(stops), SHINGLES_AT_ONCE):
        some = zip(starts[at:], stops[at : at + SHINGLES_AT_ONCE])
        yield np.array([hashed(joined[i:j], SEED) for i, j in some], dtype=np.uint64)


def majority(hashes) -> int:
    """The bits that more than half of the hashes have; ``hashes`` come some at a time."""
    import numpy as np

    counts, total = np.zeros(BITS, dtype=np.int64), 0
    for some in hashes:
        bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
        total += len(some)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority bits of the hashes of all runs of ``width`` lower-cased words."""
    return majority(hashed_runs(text, width))


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 4, out: str = "fingerprint"):
    """Adds the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def fingerprints(texts):
        import numpy as np

        found = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
        import pandas as pd

        return pd.Series(found.view(np.int64))

    return added(docs, {out: fingerprints(F.col(text))})


def segments(distance: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment; one of them differs by at most one bit."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _entries(prints: DataFrame, distance: int) -> DataFrame:
    """``bit, rest, fp``: one index entry for each bit, holding its segment without that bit."""
    entries = []
    for low, width in segments(distance):
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        for bit in range(width):
            rest = segment.bitwiseAND(F.lit(_signed(~(1 << bit) % (1 << BITS))))
            entries.append(F.struct(F.lit(low + bit).alias("bit"), rest.alias("rest")))
    return prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.bit", "e.rest", "fp")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _runs(bits, rests):
    """Starts and lengths of the runs of equal neighbours."""
    import numpy as np

    new = (bits[1:] != bits[:-1]) | (rests[1:] != rests[:-1])
    starts = np.flatnonzero(np.concatenate([[True], new]))
    return starts, np.diff(np.append(starts, len(bits)))


def _first_shared(x, distance: int):
    """The first bit whose entry two fingerprints with difference ``x`` share."""
    import numpy as np

    first = np.full(len(x), BITS, dtype=np.int64)
    for low, width in reversed(segments(distance)):
        part = (x >> np.uint64(low)) & np.uint64((1 << width) - 1)
        n = np.bitwise_count(part)
        place = np.bitwise_count(part - np.uint64(1) * (n > 0)).astype(np.int64)
        first = np.where(n == 0, low, np.where(n == 1, low + place, first))
    return first


def _forest(fps, distance: int):
    """A spanning forest of the links among ``fps``: each unseen node is compared once per seen one."""
    import numpy as np

    rest, pairs = fps, []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            node = front.pop()
            near = np.bitwise_count(rest ^ node) <= distance
            if near.any():
                found = rest[near]
                pairs.extend((node, f) for f in found)
                front.extend(found)
                rest = rest[~near]
    return pairs


def _pairs_in_short(fps, bits, starts, sizes, distance):
    """All links in runs of at most ALL_PAIRS, each in the first entry it shares."""
    import numpy as np

    out = []
    keep = (sizes > 1) & (sizes <= ALL_PAIRS)
    starts, sizes = starts[keep], sizes[keep]
    gap = 1
    while len(starts):
        length = sizes - gap
        before = np.concatenate([[0], np.cumsum(length)[:-1]])
        left = np.repeat(starts - before, length) + np.arange(length.sum())
        x = fps[left] ^ fps[left + gap]
        near = np.flatnonzero(np.bitwise_count(x) <= distance)
        if len(near):
            left, x = left[near], x[near]
            first = _first_shared(x, distance) == bits[left]
            out.append(np.stack([fps[left[first]], fps[left[first] + gap]], axis=1))
        gap += 1
        more = sizes > gap
        starts, sizes = starts[more], sizes[more]
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.uint64)


def _linked(distance: int, block: int):
    """Links inside sorted entries; the members of overlong entries are handed on."""

    def link(frames):
        import numpy as np
        import pandas as pd

        def done(frame):
            fps = frame["fp"].to_numpy().view(np.uint64)
            bits = frame["bit"].to_numpy()
            starts, sizes = _runs(bits, frame["rest"].to_numpy())
            pairs = _pairs_in_short(fps, bits, starts, sizes, distance)
            for s, n in zip(starts[sizes > ALL_PAIRS], sizes[sizes > ALL_PAIRS]):
                more = np.array(_forest(fps[s : s + n], distance), dtype=np.uint64)
                pairs = np.concatenate([pairs, more.reshape(-1, 2)])
            pairs = pairs.view(np.int64)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "bit": -1, "rest": 0})

        released()
        held, over = None, None
        for frame in frames:
            if over is not None:
                same = (frame["bit"] == over[0]) & (frame["rest"] == over[1])
                yield frame[same].rename(columns={"fp": "a"}).assign(b=0)[["a", "b", "bit", "rest"]]
                frame = frame[~same]
                if not len(frame):
                    continue
                over = None
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            last = (frame["bit"].iloc[-1], frame["rest"].iloc[-1])
            open_ = ((frame["bit"] == last[0]) & (frame["rest"] == last[1])).to_numpy()
            closed, held = frame[~open_].reset_index(drop=True), frame[open_].reset_index(drop=True)
            if len(closed):
                yield done(closed)
            if len(held) > block:
                yield held.rename(columns={"fp": "a"}).assign(b=0)[["a", "b", "bit", "rest"]]
                held, over = None, last
        if held is not None and len(held):
            yield done(held)

    return link


def _blocks_linked(distance: int):
    def link(frame):
        import numpy as np
        import pandas as pd

        pairs = np.array(_forest(frame["fp"].to_numpy().view(np.uint64), distance), dtype=np.uint64)
        pairs = pairs.reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return link


def links(prints: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that give their components."""
    entries = _entries(prints, distance).repartition("bit", "rest").sortWithinPartitions("bit", "rest")
    met = written(
        entries.mapInPandas(_linked(distance, block), "a long, b long, bit int, rest long"), "met"
    )
    long_ = met.filter("bit >= 0").select("bit", "rest", F.col("a").alias("fp"))
    blocks = long_.groupBy("bit", "rest").agg(F.ceil(F.count("*") / block).alias("n"))
    mine = F.pmod(F.xxhash64("fp"), F.col("n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    paired = (
        long_.join(blocks, ["bit", "rest"])
        .select("bit", "rest", "fp", mine.alias("m"), other.alias("o"))
        .select("bit", "rest", "fp", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"))
    )
    # Dealt by all four, so the blocks of one entry do not share a task.
    dealt = paired.repartition("bit", "rest", "i", "j").groupBy("bit", "rest", "i", "j")
    far = dealt.applyInPandas(_blocks_linked(distance), "a long, b long")
    return met.filter("bit < 0").select("a", "b").unionByName(far)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4
) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable) and ``kept``.

    Exactly one row of each component is ``kept``: one with the smallest id.
    """
    numbered = added(docs, {"_row": F.monotonically_increasing_id()})
    rows = written(with_fingerprints(numbered, text, width, "_fp"), "prints")
    # Ids before nulls, then the row: unique even if ids repeat.
    first = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("_row").alias("row"))
    classes = rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(first).alias("head"))
    roots = components(links(classes.select("fp"), distance)).withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("head").alias("_head"))
    by_print = placed.join(heads, "root").select(F.col("fp").alias("_fp"), "_head")
    return added(
        rows.join(by_print, "_fp"),
        {
            "fingerprint": F.lower(F.lpad(F.hex("_fp"), 16, "0")),
            "component_id": F.col("_head.id"),
            "kept": F.col("_head.row") == F.col("_row"),
        },
    ).drop("_fp", "_row", "_head")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without all but one row of each component."""
    columns = docs.columns
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"),
        F.col(how.pop("doc_id", "doc_id")).alias("_id"),
        F.col(how.pop("text", "text")).alias("_text"),
    )
    kept = near_duplicates(boxed, "_id", "_text", **how).filter("kept")
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns])

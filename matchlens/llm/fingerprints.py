"""MinHash fingerprints of documents, and near copies through bands of them.

A text is the set of its ``WIDTH``-word shingles: lower-cased (A to Z) words
between white space, or the whole text if it has fewer. ``HASHES`` universal
hash functions ``a x + b`` modulo ``2^32`` (``a`` odd) are taken over the set in
numpy; the smallest value of each, cut to 16 bits, makes the fingerprint. Equal
places of two fingerprints estimate the Jaccard similarity of their sets.

Near copies are found from ``BANDS`` bands of ``ROWS`` places: fingerprints that
share a band are tied in Spark by an equality join to the smallest one there, so
ties grow with the members, not with their pairs. Tied fingerprints are only
candidates: their shingle sets are compared and those with a Jaccard similarity
of ``SIMILARITY`` or more are linked. A pair at just that similarity shares no
band once in twenty thousand times. Candidate groups too long for one task are
cut into blocks and every two blocks meet in a task of their own.

Null, empty and wordless texts are the empty set; its fingerprint is all ones
and it is like itself only. Long texts are read whole. Repeated rows stay, each
with its own neighbours in the order; rows without an id come last. Extra
columns stay; those named like a result give way.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlens.llm.common import added, fresh, written
from matchlens.llm.graph import components

WIDTH, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 25
HASHES = ROWS * BANDS
BYTES = 2 * HASHES
SEED = 42
# Working memory: shingles hashed at once, words remembered by a task, length of a block.
SHINGLES_AT_ONCE = 1 << 11
KNOWN_WORDS = 1 << 17
BLOCK_CHARS = 4 << 20
# Tables of a few numbers a row are sent to tasks up to so many rows (some dozen MB).
SENT_ROWS = 1 << 21


class Hasher:
    """Shingle hashes and signatures; remembers the hashes of words."""

    def __init__(self, width: int = WIDTH):
        import numpy as np

        draw = np.random.default_rng(SEED)
        self.width, self.known = width, {}
        self.by = draw.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
        self.plus = draw.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)

    def words(self, text: str):
        """64-bit hashes of the words, in order."""
        import numpy as np
        import xxhash

        # Bytes know just these letters and just this white space.
        words = text.encode().lower().split()
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word, SEED)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, words):
        """Hashes of all runs of ``width`` words, repeats included."""
        import numpy as np

        if not len(words):
            return words
        n = min(self.width, len(words))
        odd = np.uint64(0x9E3779B97F4A7C15)
        out = np.full(len(words) - n + 1, np.uint64(n))
        for i in range(n):
            out = (out ^ words[i : len(words) - n + 1 + i]) * odd
            out ^= out >> np.uint64(29)
        return out

    def minima(self, shingles):
        """Smallest value of every hash function; all ones without shingles."""
        import numpy as np

        least = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), SHINGLES_AT_ONCE):
            hashed = np.multiply.outer(self.by, x[at : at + SHINGLES_AT_ONCE])
            hashed += self.plus
            least = np.minimum(least, hashed.min(axis=1))
        return least

    def read(self, text: str) -> "Read":
        """A text with its fingerprint; the part that its edited text shares is hashed apart, once."""
        import numpy as np
        import xxhash

        words = self.words(text)
        shingles = self.shingles(words)
        start = text[: len(text) - len(text) // 4]
        # The last word of the shared start may be cut.
        shared = max(0, len(start.encode().split()) - self.width)
        head = self.minima(shingles[:shared])
        print_ = packed(np.minimum(head, self.minima(shingles[shared:])))
        return Read(text, start, shared, head, print_, signed(xxhash.xxh64_intdigest(words.tobytes(), SEED)))

    def printed(self, one: "Read", following: "Read") -> tuple:
        """The columns of ``PRINTED`` for a text and the one after it."""
        import hashlib

        import numpy as np

        edited = one.start + following.text[: len(one.text) - len(one.start)]
        rest = self.shingles(self.words(edited))[one.shared :]
        other = packed(np.minimum(one.head, self.minima(rest)))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        near = likeness(one.print, other), likeness(one.print, following.print)
        return (len(one.text), digest, one.print, other, *near, one.node)


@dataclass
class Read:
    text: str
    start: str
    shared: int
    head: object
    print: bytes
    node: int


def packed(minima) -> bytes:
    return (minima & 0xFFFF).astype(">u2").tobytes()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def likeness(one: bytes, other: bytes) -> float:
    """Share of equal places."""
    import numpy as np

    return float((np.frombuffer(one, ">u2") == np.frombuffer(other, ">u2")).mean())


# node: equal for texts with the same words.
PRINTED = {
    "n_chars": "long",
    "edited_sha256": "string",
    "fingerprint": "binary",
    "edited_fingerprint": "binary",
    "near_edited": "double",
    "near_next": "double",
    "node": "long",
}


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` so that each task holds a stretch of the order by id, in that order.

    A table that already lies so is taken as it lies; that is told from its ids
    alone. Another one is sorted: nulls last, rows of one id by their text.
    """
    found = docs.select(F.col(doc_id).alias("id")).mapInPandas(_stretches, "low long, high long, sound boolean")
    before = Window.orderBy("low", "high")  # one row for each task
    alone = F.coalesce(F.lag("high").over(before) < F.col("low"), F.lit(True))
    apart = found.filter("NOT sound OR low IS NOT NULL").select((F.col("sound") & alone).alias("alone"))
    whole = docs.schema[doc_id].dataType.typeName() in ("long", "integer", "short", "byte")
    if whole and apart.agg(F.coalesce(F.bool_and("alone"), F.lit(True))).first()[0]:
        return docs
    return docs.orderBy(F.col(doc_id).asc_nulls_last(), F.col(text).asc_nulls_first())


def _stretches(frames):
    import pandas as pd

    low = high = None
    sound = True
    for frame in frames:
        ids = frame["id"]
        if not len(ids):
            continue
        sound = sound and not ids.isna().any() and ids.is_monotonic_increasing and ids.is_unique
        sound = sound and (high is None or ids.iloc[0] > high)
        if not sound:
            break
        low, high = (ids.iloc[0] if low is None else low), ids.iloc[-1]
    yield pd.DataFrame(
        {"low": pd.array([low], dtype="Int64"), "high": pd.array([high], dtype="Int64"), "sound": [bool(sound)]}
    )


def _neighbours(text: str, names: list[str], edge: list[str], schema):
    """Each row with the results of it and its next one; a task's first and last text are left for its neighbours.

    ``names`` are the columns that stay, ``edge`` those that hold kind, task and text of rows at an edge.
    """

    def read(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        hasher, task = Hasher(), TaskContext.get().partitionId()

        def made(rows, results, kind, texts):
            n = rows.num_rows
            columns = [rows[name] for name in names]
            columns += [[r[i] for r in results] if results else [None] * n for i in range(len(PRINTED))]
            columns += [[kind] * n, [task] * n, texts or [None] * n]
            arrays = [
                c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                for c, f in zip(columns, schema)
            ]
            return pa.Table.from_arrays(arrays, schema=schema).to_batches()

        held = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [hasher.read(t) for t in pc.fill_null(batch[text], "").to_pylist()]
            if last is None:
                yield from made(batch.slice(0, 1), None, FIRST, [texts[0].text])
            rows = pa.Table.from_batches([batch] if last is None else [held, batch])
            every = texts if last is None else [last, *texts]
            done = [hasher.printed(a, b) for a, b in zip(every, every[1:])]
            if done:
                yield from made(rows.slice(0, len(done)), done, DONE, None)
            held, last = batch.slice(batch.num_rows - 1), texts[-1]
        if last is not None:
            yield from made(held, None, LAST, [last.text])

    return read


DONE, FIRST, LAST = 0, 1, 2


def with_fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True
) -> DataFrame:
    """Adds fingerprints of each row, of its edited text, and its likeness to that and to the next row.

    The edited text has its last quarter replaced by as much of the start of the
    next row, by ascending id; the first row follows the last one. Also adds
    ``n_chars``, ``edited_sha256``, ``row_key`` (a hash of id and text) and ``node``, which texts of the same words share.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = added(docs, {"row_key": F.xxhash64(doc_id, text)})
    taken = {name.lower() for name in PRINTED}
    names = [c for c in docs.columns if c.lower() not in taken and (keep_text or c != text)]
    edge = [fresh(docs, name) for name in ("edge_kind", "edge_task", "edge_text")]
    ordered = in_order(docs, doc_id, text)
    kept = docs.select(*[F.col(f"`{c}`") for c in names]).schema
    out = StructType(list(kept.fields))
    for name, kind in PRINTED.items():
        out = out.add(name, kind)
    out = out.add(edge[0], "integer").add(edge[1], "integer").add(edge[2], "string")
    rows = written(ordered.mapInArrow(_neighbours(text, names, edge, to_arrow_schema(out)), out), "prints")
    kind, task, content = (F.col(c) for c in edge)
    first = rows.filter(kind == FIRST).select(task.alias("task"), F.col(f"`{doc_id}`").alias("id"), content.alias("text"))
    # One row for each task that has rows.
    order = Window.orderBy(F.col("id").asc_nulls_last(), "task")
    seats = first.select("task", "id", (F.row_number().over(order) - 1).alias("seat")).drop("id")
    seats = seats.withColumn("n", F.count("*").over(Window.partitionBy()))
    before = F.pmod(F.col("seat") - 1, F.col("n")).alias("before")
    starts = first.join(seats, "task").select(before, F.col("text").alias("following"))
    after = seats.join(starts, F.col("seat") == F.col("before")).select(F.col("task").alias("after"), "following")
    last = rows.filter(kind == LAST).join(after, task == F.col("after"))

    @F.pandas_udf(", ".join(f"{name} {kind}" for name, kind in PRINTED.items()))
    def finished(texts, following):
        import pandas as pd

        hasher = Hasher()
        found = [hasher.printed(hasher.read(a), hasher.read(b)) for a, b in zip(texts, following)]
        return pd.DataFrame(found, columns=list(PRINTED))

    made = fresh(rows, "made")
    last = last.withColumn(made, finished(content, F.col("following")))
    mine = [F.col(f"`{c}`") for c in names]
    return rows.filter(kind == DONE).select(*mine, *PRINTED).unionByName(
        last.select(*mine, *[F.col(f"{made}.{name}").alias(name) for name in PRINTED])
    )


def ties(nodes: DataFrame) -> DataFrame:
    """``a, b``: each ``node`` of a band with the smallest one there."""
    band = lambda i: F.xxhash64(F.lit(i), F.substring("fingerprint", 2 * ROWS * i + 1, 2 * ROWS))
    entries = nodes.select("node", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("key"))
    hubs = entries.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    met = entries.join(hubs.filter("hub <> last"), "key").filter("node <> hub")
    return met.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def spanning(sets: list, least: float = SIMILARITY):
    """Pairs of places whose links span the components of the sets at least that similar.

    Each found set is compared with all that are not yet found, in one pass over their members.
    """
    import numpy as np

    sizes = np.array(list(map(len, sets)), dtype=np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    left, pairs = np.arange(len(sets)), []
    rest, owner = ids, np.repeat(left, sizes)
    mark = np.zeros(len(ids) + 1, dtype=bool)
    while len(left) > 1:
        front, gone = [int(left[0])], left[:1]
        while front:
            if len(gone):
                stay = np.ones(len(sets), dtype=bool)
                stay[gone] = False
                left, keep = left[stay[left]], stay[owner]
                rest, owner = rest[keep], owner[keep]
            one = front.pop()
            mine = ids[starts[one] : starts[one + 1]]
            mark[mine] = True
            shared = np.bincount(owner[mark[rest]], minlength=len(sets))[left]
            mark[mine] = False
            union = sizes[one] + sizes[left] - shared
            gone = left[shared >= least * np.maximum(union, 1)]
            pairs += [(one, other) for other in gone.tolist()]
            front += gone.tolist()
    return pairs


def _linked(frame):
    """Links among the members of a group, or of two blocks of one."""
    import numpy as np
    import pandas as pd

    hasher = Hasher()
    nodes = frame["node"].to_numpy()
    sets = [np.unique(hasher.shingles(hasher.words(t or ""))) for t in frame["text"]]
    pairs = spanning(sets) if len(nodes) > 1 else []
    return pd.DataFrame({"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}, dtype="int64")


def links(members: DataFrame) -> DataFrame:
    """``a, b``: verified links inside the candidate groups ``root`` of ``root, node, blocks, text``.

    A group is cut into ``blocks`` and every two of them meet in a task of their own.
    """
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = (
        members.withColumn("m", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .select("root", "node", "text", "m", other.alias("o"))
        .select("root", "node", "text", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"))
    )
    # Dealt by all three, so the blocks of one group do not share a task.
    return paired.repartition("root", "i", "j").groupBy("root", "i", "j").applyInPandas(_linked, "a long, b long")


def near_classes(
    docs: DataFrame, prints: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK_CHARS
) -> DataFrame:
    """``node, class_id, members``: the smallest id reachable by links (null if no row there has one) and the rows that do.

    ``prints`` is ``with_fingerprints(docs)``. Only the texts of candidates are read again.
    """
    ident = F.col(doc_id)
    # Ids before nulls; the row's key finds the row that speaks for the node.
    head = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col("row_key").alias("key"), "n_chars")
    nodes = prints.groupBy("node").agg(
        F.min(head).alias("head"), F.first("fingerprint").alias("fingerprint"), F.count("*").alias("rows")
    )
    groups = components(ties(nodes))
    heads = written(nodes.select("node", "head", "rows"), "nodes")
    asked = heads.join(groups, "node").select("root", "node", "head.key", "head.n_chars")
    sizes = asked.groupBy("root").agg(F.sum("n_chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("chars") / block), F.lit(1)).cast("long").alias("blocks")
    asked = written(asked.join(sizes, "root").select("root", "node", "key", blocks), "asked")
    rows = docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("text"))
    # Repeated rows give the same text.
    members = rows.join(_sent(asked), "key").groupBy("root", "node", "blocks").agg(F.first("text").alias("text"))
    roots = components(links(members))
    placed = heads.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = placed.groupBy("root").agg(F.min("head").alias("first"), F.sum("rows").alias("members"))
    return placed.join(firsts, "root").select("node", F.col("first.id").alias("class_id"), "members")


def _sent(table: DataFrame) -> DataFrame:
    """A written table, sent to every task if it has few rows; else Spark moves both sides."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``with_fingerprints`` and ``class_id``, the smallest id among a row's near copies, itself included."""
    prints = written(with_fingerprints(docs, doc_id, text, keep_text), "fingerprints")
    found = near_classes(docs, prints, doc_id, text).filter("members > 1")
    # Most rows are alone in their class.
    found = _sent(written(found.select(F.col("node").alias("class_node"), "class_id"), "classes"))
    joined = prints.join(found, prints["node"] == found["class_node"], "left")
    class_id = F.when(F.col("class_node").isNull(), F.col(doc_id)).otherwise(F.col("class_id"))
    return added(joined, {"class_id": class_id}).drop("class_node")

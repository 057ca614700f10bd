"""How far the sources of a language differ in their use of words.

Terms are counted from pointers, not from strings: inside a task the texts of
many documents form one slice of bytes, every place where a term starts becomes
a pointer into it, and the pointers are sorted by multikey quicksort. One turn
splits every open slice by the next eight bytes of its pointers into smaller,
equal and greater; equal ones go on eight bytes further, until the term ends.
The splits keep the order of the text, which is dealt by language and source
beforehand, so a run of equal terms gives its occurrences and its documents by
source from neighbours alone. Spark adds up the runs of all tasks.

A language keeps the terms in at least ``min_documents`` of its documents. All
shares are whole billionths, smoothed by ``SMOOTHING`` and worked out in exact
decimals: ``1 + floor(10^9 (count + 5) / (N + 5 V))`` with ``N`` the count of
kept terms and ``V`` their number.

Null texts, languages and sources are read as empty; an empty name is a group
like any other. A group without terms still takes part. Equal values are ranked
by name in byte order. Empty tables give empty results. Repeated rows count.
Other columns are not read. A pair of sources costs one step for each kept term.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import written

MIN_DOCUMENTS, SMOOTHING, SCALE = 30, 5, 1_000_000_000
# Texts are put together up to so many bytes; a longer one is taken alone.
SLICE_BYTES = 16 << 20
COUNTED = "lang string, source string, term string, n long, documents long"


def term_pointers(data, offsets):
    """Starts and lengths of the terms in some texts; ``data`` are their bytes.

    Terms are letters A to Z of both cases and everything beyond ASCII, so
    whole bytes tell them apart. No term reaches into the next text.
    """
    import numpy as np

    inside = (data >= 0x80) | (((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    # A text's first and last byte have no neighbour.
    some = np.flatnonzero(np.diff(offsets))
    opens[offsets[some]] = inside[offsets[some]]
    closes[offsets[some + 1] - 1] = inside[offsets[some + 1] - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1 - starts


def sorted_pointers(data, starts, lengths):
    """Multikey quicksort of the terms at ``starts``: their order and where each run of equal ones starts.

    All open slices are split in the same turn. The order of equal terms is kept.
    """
    import numpy as np

    n = len(starts)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    # Eight bytes from every place, as one number that compares like them.
    eight = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    order, new = np.arange(n), np.zeros(n, dtype=bool)
    new[:1] = True
    low, high = np.array([0]), np.array([n])
    depth = np.array([0])
    while len(low):
        sizes = high - low
        before = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(low)), sizes)
        pointer = order[np.arange(len(owner)) + (low - before)[owner]]
        at = depth[owner]
        left = lengths[pointer] - at
        key = eight[np.minimum(starts[pointer] + at, len(eight) - 1)].astype(np.uint64)
        # Bytes after the end of a term count as zero, which no term holds.
        over = (8 - np.clip(left, 0, 8)).astype(np.uint64) * np.uint64(8)
        key = np.where(left > 0, (key >> np.minimum(over, np.uint64(56))) << np.minimum(over, np.uint64(56)), np.uint64(0))
        pivot = _middle(key[before], key[before + sizes // 2], key[before + sizes - 1])
        # Places of the smaller, equal and greater ones, each in their order.
        parts, begin, ends = [], low, np.append(before, len(owner))
        for chosen in (key < pivot[owner], key == pivot[owner], key > pivot[owner]):
            upto = np.concatenate([[0], np.cumsum(chosen)])
            mine = upto[ends[1:]] - upto[ends[:-1]]
            to = (begin - upto[before])[owner[chosen]] + upto[:-1][chosen]
            order[to] = pointer[chosen]
            new[begin[mine > 0]] = True
            parts.append((begin, begin + mine))
            begin = begin + mine
        goes_on = (pivot & np.uint64(0xFF)) > 0
        steps = [(parts[0], depth, None), (parts[1], depth + 8, goes_on), (parts[2], depth, None)]
        lows, highs, depths = [], [], []
        for (a, b), deep, only in steps:
            open_ = b - a > 1 if only is None else (b - a > 1) & only
            lows.append(a[open_])
            highs.append(b[open_])
            depths.append(deep[open_])
        low, high, depth = np.concatenate(lows), np.concatenate(highs), np.concatenate(depths)
    return order, new


def _middle(a, b, c):
    import numpy as np

    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def counted_slice(lang, source, text):
    """One row for each term, language and source of some documents, given as Arrow arrays.

    A row without a term stands for every language and source that occurs.
    """
    import numpy as np
    import pyarrow as pa

    def codes(names):
        coded = names.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    langs, lang_names = codes(lang)
    sources, source_names = codes(source)
    group = langs * len(source_names) + sources
    dealt = np.argsort(group, kind="stable")
    text, group = text.take(pa.array(dealt)), group[dealt]
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    bytes_ = text.buffers()[2]
    whole = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ is not None else np.empty(0, dtype=np.uint8)
    data = whole[offsets[0] : offsets[-1]].copy()
    offsets = offsets - offsets[0]
    starts, lengths = term_pointers(data, offsets)
    data[(data >= 0x41) & (data <= 0x5A)] |= 0x20
    order, new = sorted_pointers(data, starts, lengths)
    document = (np.searchsorted(offsets, starts, side="right") - 1)[order]
    mine = group[document]
    change = lambda of: np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
    heads = np.flatnonzero(new | change(mine))
    counts = np.diff(np.append(heads, len(order)))
    seen = np.add.reduceat(new | change(document), heads, dtype=np.int64) if len(heads) else counts
    first, size = starts[order[heads]], lengths[order[heads]]
    to = np.concatenate([[0], np.cumsum(size)])
    spelled = data[np.repeat(first - to[:-1], size) + np.arange(to[-1])]
    terms = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(spelled))
    present = np.unique(group)
    groups = np.concatenate([mine[heads], present])
    zeros = np.zeros(len(present), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            lang_names.take(pa.array(groups // len(source_names))),
            source_names.take(pa.array(groups % len(source_names))),
            pa.concat_arrays([terms, pa.nulls(len(present), pa.large_string())]).cast(pa.string()),
            pa.array(np.concatenate([counts, zeros])),
            pa.array(np.concatenate([seen, zeros])),
        ],
        names=["lang", "source", "term", "n", "documents"],
    )


def _counted(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0

    def slice_():
        whole = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: whole[name].chunk(0)
        return counted_slice(column("lang"), column("source"), column("text"))

    for batch in batches:
        if not batch.num_rows:
            continue
        filled = [pc.fill_null(batch[name].cast(pa.string()), "") for name in ("lang", "source")]
        text = pc.fill_null(batch["text"].cast(pa.large_string()), "")
        if held and size + text.nbytes > SLICE_BYTES:
            yield slice_()
            held, size = [], 0
        held.append(pa.RecordBatch.from_arrays([*filled, text], names=["lang", "source", "text"]))
        size += text.nbytes
    if held:
        yield slice_()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, documents``: occurrences of every term and the documents that hold it.

    Each language and source also has one row whose term is null.
    """
    names = {"text": text, "lang": lang, "source": source}
    rows = docs.select(*[F.col(c).cast("string").alias(name) for name, c in names.items()])
    return (
        rows.mapInArrow(_counted, COUNTED)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    )


def _share(n: Column, total: Column, kept: Column) -> Column:
    """Whole billionths of ``n`` in ``total``, smoothed; exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    fixed = lambda i: F.lit(i).cast("decimal(10,0)")
    part = (wide(n) + fixed(SMOOTHING)) * fixed(SCALE)
    return F.call_function("div", part, wide(total) + wide(kept) * fixed(SMOOTHING)).cast("long") + 1


def divergence(counts: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` from ``term_counts``.

    ``pair``: distance to each other source of the language, all of them.
    ``term``: the ``top`` terms that the source uses more than its language does.
    """
    counts = written(counts, "term_counts")
    vocabulary = (
        counts.filter("term IS NOT NULL")
        .groupBy("lang", "term")
        .agg(F.sum("documents").alias("documents"), F.sum("n").alias("lang_n"))
        .filter(F.col("documents") >= min_documents)
        .select("lang", "term", "lang_n")
    )
    kept = written(counts.join(vocabulary, ["lang", "term"]), "kept_terms")
    # One row for each source, kept terms or not.
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = (
        kept.groupBy("lang", "term")
        .agg(F.first("lang_n").alias("lang_n"))
        .groupBy("lang")
        .agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    )
    groups = (
        counts.filter("term IS NULL")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .na.fill(0, ["total", "kept", "lang_total"])
    )
    groups = written(groups, "groups")
    return _pairs(kept, groups).unionByName(_terms(kept, groups, top)).select(
        "lang", "source", "part", "item", "value", "rank"
    )


def _ranked(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums over a language's kept terms for every two of its sources; each two are met once."""
    sources = groups.groupBy("lang").agg(
        F.first("kept").alias("kept"), F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources")
    )
    # At most one entry for each source of the language.
    terms = kept.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("n"))
    count = lambda s: F.coalesce(F.try_element_at("n", s["source"]), F.lit(0).cast("long"))
    shares = terms.join(sources, "lang").select(
        "lang", F.transform("sources", lambda s: _share(count(s), s["total"], F.col("kept"))).alias("p")
    )
    one = shares.select("lang", "p", F.posexplode("p").alias("i", "pi"))
    # Only the places after the first one.
    two = one.select(
        "lang", "i", "pi", F.posexplode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("j", "pj")
    )
    sums = two.groupBy("lang", "i", (F.col("i") + F.col("j") + 1).alias("j")).agg(
        F.sum(F.abs(F.col("pi") - F.col("pj"))).alias("value")
    )
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    seats = sources.select("lang", F.posexplode("sources").alias("i", "s")).select("lang", "i", "s.source")
    every = seats.join(seats.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), "lang")
    rows = every.filter("i <> j").join(both, ["lang", "i", "j"], "left")
    return _ranked(
        rows.select(
            "lang", "source", F.lit("pair").alias("part"), "item",
            F.coalesce("value", F.lit(0).cast("long")).alias("value"),
        )
    )


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    rows = kept.join(groups, ["lang", "source"])
    own = _share(F.col("n"), F.col("total"), F.col("kept"))
    usual = _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = rows.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (own - usual).alias("value")
    ).filter("value > 0")
    return _ranked(more).filter(F.col("rank") <= top)

"""Quality rules with thresholds learned from quantile sketches by language and source.

Each text is measured with column functions. Two measures have fixed base
rules (too few words, too much repetition). The rest are held against fences:
quartiles of their group plus a multiple of the distance between the quartiles.
Shares that are zero in most texts have equal quartiles; they also are held
against their group's tail: a high quantile plus its distance to a lower one.
The quantiles come from KLL sketches of every language and source, built next
to the data and merged, also into sketches by language and of everything; a
group too small to speak for itself uses the sketch above it. Documents are
joined with the fences of their group and kept if no measure lies outside.

Null texts have no words. Null languages and sources form groups of their own.
Empty tables give empty results. Repeated rows count and are judged like any
other. Extra columns stay; those named like a result give way.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added, written
from matchlens.stages import observed

MIN_WORDS = 50
MAX_REPEATED = 0.5
# Sketch size: exact for groups of fewer rows, ranks within about 0.3 % for larger ones.
SKETCH_K = 1024
MIN_GROUP = 100
REACH = 6.0
# At most this many fences are sent to every task.
SENT_FENCES = 20_000
SPACE = r"[\x20\x09-\x0D]+"
# Measure: the least distance between quartiles, so even groups of one kind leave some room.
SPREADS = {
    "symbol_share": 0.01,
    "dup_line_share": 0.1,
    "repeat_share": 0.08,
    "word_length": 0.5,
}
# Measures with a fence from the tail, and the least room beyond the high quantile.
TAILS = {"symbol_share": 0.01, "dup_line_share": 0.05, "repeat_share": 0.05}
TAIL, TAIL_FROM = 0.95, 0.75


def _hashes(words: Column) -> Column:
    """64-bit hashes of all windows of three words."""
    n = F.size(words)
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )


def _covered(windows: Column) -> Column:
    """Words inside windows that stand twice or more; ``windows`` are sorted (hash, place).

    Equal neighbours are repeated. Each repeated window adds the words that the
    one before it in the text does not cover.
    """
    same = lambda i, j: F.get(windows, i)["hash"] == F.get(windows, j)["hash"]
    twice = F.filter(
        windows,
        lambda w, i: F.coalesce(same(i, i + 1), F.lit(False))
        | ((i > 0) & F.coalesce(same(i, F.greatest(i - 1, F.lit(0))), F.lit(False))),
    )
    places = F.sort_array(F.transform(twice, lambda w: w["place"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")
        ),
        lambda acc: acc["n"],
    )
    return covered


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts (``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_lines``) and the measures made from them."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = added(
        docs,
        {
            "_words": F.array_remove(F.split(content, SPACE), ""),
            "_lines": F.filter(F.split(content, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
        },
    )
    rows = added(rows, {"_hashes": _hashes(F.col("_words"))})
    windows = F.array_sort(
        F.transform("_hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    )
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = added(rows, {"_windows": F.when(some, windows)})
    rows = added(
        rows,
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(content, SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(content, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(_covered(F.col("_windows")), F.lit(0)).cast("long"),
        },
    ).drop("_words", "_lines", "_hashes", "_windows")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return added(
        rows,
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words")),
        },
    )


def fences(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source`` with ``<measure>_low``, ``_high`` and for some ``_tail`` for every group of ``rows``.

    Rows that failed the base rules do not shape the fences.
    """
    keys = [F.col(lang).alias("_lang"), F.col(source).alias("_source")]
    usable = F.col("base_failed") == F.lit(False)
    sketch = lambda m: F.expr(f"kll_sketch_agg_double(`{m}`, {SKETCH_K})").alias(m)
    merge = lambda m: F.expr(f"kll_merge_agg_double(`{m}`, {SKETCH_K})").alias(m)
    small = written(
        rows.filter(usable)
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), *[sketch(m) for m in SPREADS]),
        "sketches",
    )
    merged = [F.sum("n").alias("n"), *[merge(m) for m in SPREADS]]
    by_lang = small.groupBy("_lang").agg(*merged)
    overall = small.agg(*merged)
    groups = rows.select(*keys).distinct()

    def bounds(sketches: DataFrame, level: str) -> DataFrame:
        out = []
        for m, least in SPREADS.items():
            at = lambda q: F.expr(f"kll_sketch_get_quantile_double(`{m}`, {q})")  # noqa: B023, E731
            room = REACH * F.greatest(at(0.75) - at(0.25), F.lit(least))
            out += [(at(0.25) - room).alias(f"{m}_low"), (at(0.75) + room).alias(f"{m}_high")]
            if m in TAILS:
                room = F.greatest(at(TAIL) - at(TAIL_FROM), F.lit(TAILS[m]))
                out.append((at(TAIL) + room).alias(f"{m}_tail"))
        keyed = [c for c in ("_lang", "_source") if c in sketches.columns]
        enough = sketches.filter(F.col("n") >= (MIN_GROUP if level != "all" else 1))
        return enough.select(*keyed, F.struct(*out).alias(level))

    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    own, langs, top = bounds(small, "own"), bounds(by_lang, "lang"), bounds(overall, "all")
    found = groups.join(own, same(groups, own, ["_lang", "_source"]), "left").select(
        groups["_lang"], groups["_source"], "own"
    )
    found = found.join(langs, same(found, langs, ["_lang"]), "left").select(
        found["_lang"], found["_source"], "own", langs["lang"].alias("by_lang")
    )
    one = F.broadcast(top)  # a single row
    found = found.join(one, F.lit(True), "left").withColumn("f", F.coalesce("own", "by_lang", "all"))
    return found.select("_lang", "_source", "f.*")


def judged(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with counts, measures, ``base_failed`` and ``kept``; without the text if so asked.

    The measures are written once for the fences. With the text they are taken
    anew for the verdicts, which costs less than a copy of all texts.
    """
    # The observation point keeps the verdict from being worked out anew for each use of a measure.
    rows = observed(measured(docs, text), "measured", "base_failed")
    if keep_text:
        small = written(rows.select(lang, source, "base_failed", *SPREADS), "measures")
    else:
        small = rows = written(rows.drop(text), "measures")
    limits = written(fences(small, lang, source), "fences")
    if limits.count() <= SENT_FENCES:
        limits = F.broadcast(limits)
    joined = rows.join(
        limits,
        F.col(lang).eqNullSafe(limits["_lang"]) & F.col(source).eqNullSafe(limits["_source"]),
        "left",
    )
    return _verdicts(joined)


def _verdicts(joined: DataFrame) -> DataFrame:
    inside = F.lit(True)
    for m in SPREADS:
        inside = inside & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
    for m in TAILS:
        inside = inside & F.coalesce(F.col(m) <= F.col(f"{m}_tail"), F.lit(True))
    inside = inside & F.coalesce(F.col("word_length") >= F.col("word_length_low"), F.lit(True))
    ends = [f"{m}_{end}" for m in SPREADS for end in ("low", "high")] + [f"{m}_tail" for m in TAILS]
    return added(joined, {"kept": ~F.col("base_failed") & inside}).drop("_lang", "_source", *ends)


def accepted(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    columns = docs.columns
    text, lang, source = (how.get(c, c) for c in ("text", "lang", "source"))
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"),
        F.col(text).alias("_text"),
        F.col(lang).alias("_l"),
        F.col(source).alias("_s"),
    )
    kept = judged(boxed, "_text", "_l", "_s").filter("kept")
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns])

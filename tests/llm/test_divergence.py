"""Term counts and source distances against a plain version."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchlens.llm import divergence
from matchlens.llm.common import ready

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(rows):
    n, documents = Counter(), defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        n[lang or "", source or "", None] += 0
        for word in TERM.findall(text or ""):
            key = (lang or "", source or "", word.translate(LOWER))
            n[key] += 1
            documents[key].add(i)
    return {k: (c, len(documents[k])) for k, c in n.items()}


def diverged(rows, least, top):
    found = counted(rows)
    groups = {k[:2] for k in found}
    by_lang, documents = defaultdict(Counter), defaultdict(Counter)
    for (lang, _, term), (n, d) in found.items():
        if term is not None:
            by_lang[lang][term] += n
            documents[lang][term] += d
    out = []
    for lang, source in groups:
        kept = [t for t in by_lang[lang] if documents[lang][t] >= least]

        def shares(count):
            total = sum(map(count, kept))
            return {t: 1 + 10**9 * (count(t) + 5) // (total + 5 * len(kept)) for t in kept}

        own = lambda s: lambda t: found.get((lang, s, t), (0, 0))[0]  # noqa: B023, E731
        p, q = shares(own(source)), shares(by_lang[lang].__getitem__)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                o = shares(own(other))
                pairs.append((-sum(abs(p[t] - o[t]) for t in kept), other.encode()))
        terms = [(q[t] - p[t], t.encode()) for t in kept if own(source)(t) and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, i.decode(), -v, k) for k, (v, i) in enumerate(items, 1)]
    return sorted(out)


def texts(n, seed):
    draw = random.Random(seed)
    words = ["a", "b", "Ab", "abcdefgh", "abcdefghi", "ABCDEFGHabcdefgh", "é", "中文", "x😀y", "İst", "zz"]
    words += [f"w{'abcdefghij'[i % 10] * (i % 17)}" for i in range(60)]
    weight = [1 / (1 + i) for i in range(len(words))]
    for _ in range(n):
        yield draw.choice([" ", "-", "1", "\x00"]).join(draw.choices(words, weight, k=draw.randint(0, 60)))


def test_slices_equal_a_plain_count():
    draw = random.Random(2)
    for seed in range(60):
        rows = [(t, draw.choice(["en", ""]), draw.choice("ab")) for t in texts(draw.randint(1, 12), seed)]
        text, lang, source = (pa.array(c) for c in zip(*rows))
        out = divergence.counted_slice(lang, source, text.cast(pa.large_string())).to_pylist()
        assert len(out) == len({(r["lang"], r["source"], r["term"]) for r in out})
        assert {(r["lang"], r["source"], r["term"]): (r["n"], r["documents"]) for r in out} == counted(rows)


def test_order_of_pointers_is_byte_order():
    import numpy as np

    rows = list(texts(30, 5))
    data = np.frombuffer("".join(rows).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *[len(r.encode()) for r in rows]])
    starts, lengths = divergence.term_pointers(data, offsets)
    order, new = divergence.sorted_pointers(data, starts, lengths)
    spelled = [data[starts[i] : starts[i] + lengths[i]].tobytes() for i in order]
    assert spelled == sorted(spelled)
    assert new.tolist() == [i == 0 or spelled[i] != spelled[i - 1] for i in range(len(spelled))]
    assert all(order[i] < order[i + 1] for i in range(len(order) - 1) if not new[i + 1])  # stable


@pytest.mark.parametrize("size", [500, divergence.SLICE_BYTES])
def test_divergence_equals_a_plain_version(spark, monkeypatch, size):
    ready(spark)
    monkeypatch.setattr(divergence, "SLICE_BYTES", size)  # several slices in a task, or one
    draw = random.Random(4)
    rows = [
        (t, draw.choice(["en", "en", "fr", None]), draw.choice(["s1", "s1", "s2", "s3", None])) for t in texts(300, 9)
    ]
    rows += [(None, "de", "s1"), ("", "de", "s2"), (None, None, "s9"), ("é " * 50_000 + "zz", "en", "long")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("x"))
    for least, top in ((30, 50), (3, 4), (10**6, 50)):
        got = divergence.divergence(divergence.term_counts(docs), least, top).collect()
        assert sorted(tuple(r) for r in got) == diverged(rows, least, top)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergence(divergence.term_counts(docs)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    n, total, kept = 4 * 10**17 + 3, 9 * 10**17 + 1, 10**9
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * kept)

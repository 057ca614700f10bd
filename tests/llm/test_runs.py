"""Periodic runs against a plain search."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from matchlens.llm import queries, runs
from matchlens.llm.common import ready, table


def plain(words, min_words=6, min_exponent=4):
    """Runs by comparing words at every distance; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(
        ((a, n, q) for (a, n), q in found.items() if n >= max(min_words, min_exponent * q)),
        key=lambda r: (r[0], r[2]),
    )


def collapsed(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_a_plain_search():
    draw = random.Random(7)
    for _ in range(600):
        letters = "abcde"[: draw.choice([1, 2, 2, 3, 5])]
        docs = []
        for _ in range(draw.randint(1, 5)):
            words = [draw.choice(letters) for _ in range(draw.randint(0, 40))]
            if words and draw.random() < 0.5:
                a, p = draw.randrange(len(words)), draw.randint(1, 6)
                words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
            docs.append(words)
        least = draw.choice([(6, 4), (2, 2), (4, 3)])
        rows, per, kept = runs.found_in([[w.encode() for w in d] for d in docs], *least)
        rows = iter(map(tuple, rows.tolist()))
        for words, n, text in zip(docs, per, kept):
            want = plain(words, *least)
            assert [next(rows) for _ in range(n)] == want
            assert text == collapsed(words, want)


def test_suffix_arrays_equal_their_definition():
    import numpy as np

    draw = random.Random(1)
    for _ in range(100):
        symbols = [draw.randint(0, 2) for _ in range(draw.randint(0, 30))] + [99]
        sa, isa, lcp = runs.suffix_arrays(np.array(symbols))
        assert sa.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
        assert [isa[s] for s in sa] == list(range(len(symbols)))
        for k in range(1, len(symbols)):
            a, b = symbols[sa[k - 1] :], symbols[sa[k] :]
            assert lcp[k] == next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


def test_edges(spark):
    ready(spark)
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, "a " * 6, "x"), (4, "a " * 6, "x"),
        (None, "a b " * 4 + "c", "x"), (5, "é " * 100_000, "x"), (6, "a " * 5, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string").withColumn("found", F.lit(1))
    out = runs.with_runs(docs)
    assert out.columns == ["doc_id", "text", "found", "runs", "collapsed"]
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()))
    assert got == [
        (0, [(0, 8, 2)], "a b c"), (1, [], ""), (2, [], ""), (3, [], ""),
        (4, [(0, 6, 1)], "a"), (4, [(0, 6, 1)], "a"), (5, [(0, 100_000, 1)], "é"), (6, [], "a a a a a"),
    ]
    assert runs.with_runs(docs.limit(0)).count() == 0


def test_query_equals_a_plain_search(spark, sf_dir):
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    chosen = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            chosen += 1
        if n > 2000:
            continue  # too long for the plain search
        words = [w.decode() for w in words]
        want = plain(words)
        best = None
        for r in want:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        row = got[doc_id]
        assert row.n_runs == len(want)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in want)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
    assert chosen > 5

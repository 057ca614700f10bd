"""Fingerprints, edited texts and near copies against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import fingerprints, queries
from matchlens.llm.common import ready, table


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, following):
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def test_query_equals_its_definition(spark, sf_dir):
    docs = sorted(table(ready(spark), sf_dir, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.document_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    hasher, far = fingerprints.Hasher(), []
    for (doc_id, text), (next_id, following) in zip(docs, docs[1:] + docs[:1]):
        text, following, row = text or "", following or "", got[doc_id]
        new = edited(text, following)
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert row.fingerprint == hasher.read(text).print.hex()
        assert row.edited_fingerprint == hasher.read(new).print.hex()
        assert row.near_next == fingerprints.likeness(hasher.read(text).print, hasher.read(following).print)
        far += [row.near_edited - jaccard(text, new), row.near_next - jaccard(text, following)]
    # The estimate has no bias and a standard error below 0.05.
    assert abs(np.mean(far)) < 0.01 and np.sqrt(np.mean(np.square(far))) < 0.05


@pytest.mark.parametrize("parts", [1, 7])
def test_order_does_not_depend_on_how_rows_lie(spark, parts):
    """Stored in order (one or many tasks), or dealt anyhow: the next row is the same."""
    ready(spark)
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 50, draw.integers(0, 60))) for _ in range(40)]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    want = {i: edited(t, n) for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1])}
    lying = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lying = lying.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id") if parts > 1 else lying
    dealt = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts + 1)
    for docs in (lying, dealt, dealt.withColumn("doc_id", F.col("doc_id").cast("double"))):
        got = {r.doc_id: r.edited_sha256 for r in fingerprints.with_fingerprints(docs).collect()}
        assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_stored_order_is_told_from_ids(spark, plan_of):
    docs = spark.range(0, 100, 1, 4).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert "Sort" not in plan_of(fingerprints.in_order(docs, "doc_id", "text"))
    for other in (docs.withColumn("doc_id", -F.col("doc_id")), docs.withColumn("doc_id", F.col("doc_id") % 50),
                  docs.withColumn("doc_id", F.expr("nullif(doc_id, 3)")), docs.unionByName(docs)):
        assert "Sort" in plan_of(fingerprints.in_order(other, "doc_id", "text"))


@pytest.mark.parametrize("block", [400, fingerprints.BLOCK_CHARS])  # long groups are cut into blocks
def test_classes_equal_brute_force(spark, monkeypatch, block):
    ready(spark)
    monkeypatch.setattr(fingerprints, "SENT_ROWS", 0 if block == 400 else fingerprints.SENT_ROWS)
    draw = np.random.default_rng(8)
    texts = []
    for _ in range(10):
        base = [f"w{i}" for i in draw.integers(0, 5000, 120)]
        texts.append(" ".join(base))
        for changes in (0, 1, 1, 2, 2, 3, 4, 6, 9):
            copy = list(base)
            for i in draw.integers(0, 120, changes):
                copy[i] = f"x{draw.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "two words", "Two  words", "words two"]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = fingerprints.with_fingerprints(docs).cache()
    found = fingerprints.near_classes(docs, prints, block=block)
    got = {r.doc_id: r.class_id for r in prints.join(found, "node").collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    if block == fingerprints.BLOCK_CHARS:
        whole = fingerprints.near_duplicates(docs).collect()
        assert {r.doc_id: r.class_id for r in whole} == got


def test_edges(spark):
    ready(spark)
    rows = [
        (5, "a b c d e f g h", 1), (5, "a b c d e f g h", 2), (5, "other text", 3), (None, "a b c d e f g h", 4),
        (None, None, 5), (1, None, 6), (2, "", 7), (9, "w " * 100_000, 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Node long").withColumn("edge_task", F.lit("x"))
    out = fingerprints.near_duplicates(docs)
    assert len(out.columns) == len({c.lower() for c in out.columns}) and "edge_task" in out.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_chars, r.class_id) for r in out.collect()))
    assert got == [
        (False, 1, 0, 1), (False, 2, 0, 1), (False, 5, 10, 5), (False, 5, 15, 5), (False, 5, 15, 5),
        (False, 9, 200_000, 9), (True, 0, 0, 1), (True, 0, 15, 5),
    ]
    assert fingerprints.near_duplicates(docs.limit(0)).count() == 0
    one = fingerprints.with_fingerprints(docs.filter("doc_id = 9")).first()
    assert one.near_next == 1.0  # a lone row follows itself


def test_blocks_of_one_group_are_dealt_apart(spark, plan_of):
    """A hot group does not fall into one task, also where no table is sent."""
    ready(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(7, i, 4, f"word{i} " * 40) for i in range(120)]
        members = spark.createDataFrame(rows, "root long, node long, blocks long, text string")
        plan = plan_of(fingerprints.links(members), "simple")
        dealt = [line for line in plan.splitlines() if "hashpartitioning(root" in line]
        assert dealt and all("i#" in line and "j#" in line for line in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

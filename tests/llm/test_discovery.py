"""Identifiers found from the contexts of those that the base rules know."""

import pytest
from pyspark.sql import functions as F

from matchlens.llm import pii
from matchlens.llm.common import ready


def found(spark, texts):
    ready(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_spans(docs).orderBy("doc_id").select("text", F.filter("spans", lambda s: s["kind"] == "id").alias("s"))
    return [r.text[s.start : s.end] for r in rows.collect() for s in r.s]


def known(label, n):
    return [f"w{i} {label} +1 202 555 {1000 + i} next{i}" for i in range(n)]


def unseen(label, n, start=0):
    return [f"v{i} {label} 0176-{40000 + i} then{i}" for i in range(start, start + n)]


@pytest.mark.parametrize("seeds, new", [(90, 10), (50, 50), (10, 90)])
def test_any_share_of_unseen_identifiers_is_found(spark, seeds, new):
    got = found(spark, known("phone:", seeds) + unseen("phone:", new))
    assert sorted(got) == [f"0176-{40000 + i}" for i in range(new)]


def test_ordinary_words_find_nothing(spark):
    """Numbers after a word that mostly stands before other words."""
    prose = [f"a house in town{i} and in summer{i}" for i in range(100)]
    assert found(spark, known("in", 20) + unseen("in", 10) + prose) == []
    assert found(spark, unseen("phone", 10) + known("phone", 2)) == []


def test_glued_labels_and_instances_seen_elsewhere(spark):
    """A number that mostly stands in other contexts is no identifier."""
    glued = [f"x{i} tel=+1 202 555 {1000 + i} y{i}" for i in range(20)] + ["so tel=0176-55555 it"]
    assert found(spark, glued) == ["0176-55555"]
    dates = [f"on{i} 2024-05-17 at{i}" for i in range(30)] + ["call phone 2024-05-17 now"]
    assert found(spark, known("phone", 20) + dates + unseen("phone", 1)) == ["0176-40000"]


def test_without_texts(spark):
    ready(spark)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "of 123456")], "doc_id long, text string")
    assert pii.with_spans(docs).filter(F.size("spans") > 0).count() == 0
    assert pii.with_spans(docs.limit(0)).count() == 0

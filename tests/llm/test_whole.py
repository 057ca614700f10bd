"""Operators whose fitted or indexed parts are bounded still do the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchlens.llm import chat, common, langid, pii, ppm, quality, shingles
from matchlens.llm.common import ready, table


def _jaccard(a, b):
    def runs(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [400, shingles.BLOCK_CHARS])  # long groups are cut into blocks
def test_near_copies_equal_brute_force(spark, block):
    ready(spark)
    draw = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        base = [f"w{i}" for i in draw.integers(0, 5000, 120)]
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 2, 3, 4, 6, 9):
            copy = list(base)
            for i in draw.integers(0, 120, changes):
                copy[i] = f"x{draw.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted(i for i in range(len(texts)) if find(i) == i)
    assert 12 < len(want) < len(texts) - 24
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(docs, block=block).collect()) == want
    if block == shingles.BLOCK_CHARS:
        stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
        assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == want


def test_byte_scores_do_not_depend_on_what_is_sent(spark, sf_dir):
    """A trie too large to send whole scores every text as the whole one does."""
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text").limit(80)
    training = docs.filter("doc_id % 3 > 0")
    whole = {r.doc_id: r.score for r in ppm.scored(docs, *ppm.fit(training)).collect()}
    for nodes in (0, 3000):
        cut = {r.doc_id: r.score for r in ppm.scored(docs, *ppm.fit(training, nodes=nodes)).collect()}
        assert cut == pytest.approx(whole, rel=1e-9)
    assert len(set(whole.values())) > 20


def test_languages_do_not_depend_on_what_is_sent(spark):
    """A language whose words are all rare keeps its words, n-grams and totals."""
    ready(spark)
    rows = [("the thing is here and the dog is there", "en")] * 40
    rows += [("der schatz ist schwarz und der hund", "de"), ("kissa istuu talossa", "fi")]
    training = spark.createDataFrame(rows, "text string, lang string")
    asked = ["kissa talossa", "kissat", "schatzer und the", "the dog istuu", "aaaa kisskiss", "qqq", "12", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "id long, text string")
    found = {}
    for words, grams in ((1 << 17, 1 << 17), (7, 1 << 17), (6, 10), (0, 0)):
        model = langid.fit(training, kept_words=words, kept_grams=grams)
        assert model.langs == ["de", "en", "fi"]
        found[words] = sorted(langid.identified(docs, model).drop("text").collect())
    for few in (7, 6, 0):
        for one, other in zip(found[1 << 17], found[few]):
            assert one[:2] == other[:2] and one["score"] == pytest.approx(other["score"], rel=1e-9)
    assert [r["lang_pred"] for r in found[0]][:2] == ["fi", "fi"]


def test_fences_follow_the_tail_of_a_group(spark):
    """A third of repeated lines is out of line among clean texts, and usual where many have them."""
    ready(spark)
    draw = np.random.default_rng(3)
    rows = []
    for i in range(400):
        source = "forum" if i % 2 else "book"
        lines = [" ".join(f"w{j}" for j in draw.integers(0, 10**6, 8)) for _ in range(12)]
        if source == "forum" and i % 5 == 1 or i == 100:
            lines += ["reply to this"] * 7
        rows.append((i, "\n".join(lines), "en", source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = [r.doc_id for r in quality.judged(docs).filter("not kept").collect()]
    assert gone == [100]


def test_addresses_with_leading_zeros():
    text = "000000001.2.3.000000255 000000256.1.1.1 0000000000.0.0.0 1.2.3.1000"
    assert [text[a:b] for kind, a, b in pii.base_spans(text) if kind == "ip"] == [
        "000000001.2.3.000000255", "0000000000.0.0.0",
    ]


def test_roles_with_commas_are_no_exchange(spark):
    ready(spark)
    rows = [(1, 0, "user,assistant", "a"), (2, 0, "system,user", "b"), (2, 1, "assistant", "c"), (3, 0, "user", "d"), (3, 1, "assistant", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = {r.conv_id: r for r in chat.canonical(chat.records_of(df)).collect()}
    assert [made[i].layout for i in (1, 2, 3)] == ["messages", "messages", "prompt"]
    assert [[tuple(t) for t in made[i].turns] for i in (1, 2)] == [[("user,assistant", "a")], [("system,user", "b"), ("assistant", "c")]]


def test_intermediates_of_a_stage_go_with_the_next(spark, tmp_path):
    """They stay while an output still reads from them."""
    from pathlib import Path

    ready(spark)
    docs = spark.createDataFrame([(i, f"the cat number {i} " * 20, "en", "a") for i in range(40)], "doc_id long, text string, lang string, source string")
    shared = Path(common.shared_dir(spark))
    mine = lambda name: [p for p in shared.glob(f"{name}-*") if p.is_dir()]
    stages = [function for _, function in corpus_pipeline.STAGES]
    common._built.clear()
    before = {name: len(mine(name)) for name in ("language", "quality_rules")}
    told = stages[0](spark, docs, "")
    stages[1](spark, told, "")
    assert len(mine("language")) == before["language"] + 1  # not evaluated yet
    told.write.parquet(str(tmp_path / "told"))
    stages[1](spark, spark.read.parquet(str(tmp_path / "told")), "").collect()
    assert len(mine("language")) == before["language"]
    assert len(mine("quality_rules")) == before["quality_rules"] + 2

"""Nulls, empty tables, repeated rows, ties, long texts and clashing names for every operator."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchlens.llm import byte_bpe, chat, common, covertree, graph, langid, packing, pii, ppm, quality
from matchlens.llm import queries, sharding, shingles, simhash
from matchlens.llm.common import ready

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, Kept int"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PLAIN = "the cat and the dog went to a house by the sea " * 6


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    rows = [
        (1, PLAIN + "one", "en", "a", 1, "x", 1),
        (2, PLAIN + "one", "en", "a", 1, "x", 1),
        (2, PLAIN + "one", "en", "a", 1, "x", 1),
        (3, None, "en", None, None, None, None),
        (4, "", None, "a", 0, "x", 0),
        (5, " \n\t ", "en", "a", 0, "x", 0),
        (None, "le chat et le chien sont dans la maison " * 5, "fr", "b", 1, "x", 1),
        (6, "mail bob@ex.com now +1 (227) 555-6608 or 10.0.0.1, 4218332753117222", "en", "b", 1, "x", 1),
        (7, "w" * 100_000 + " end", "en", "b", 1, "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def outputs(docs):
    model = langid.fit(docs)
    lm, words = ppm.fit(docs)
    return {
        "quality": quality.judged(docs, keep_text=False),
        "pii": pii.with_spans(docs),
        "simhash": simhash.near_duplicates(docs),
        "packing": packing.packed(packing.pieces(docs, WORDS)),
        "sharding": sharding.sharded(docs, 3),
        "ppm": ppm.scored(docs, lm, words),
        "langid": langid.identified(docs, model),
        "bpe": byte_bpe.with_decoded(byte_bpe.with_ids(docs, RANKS, public_tokenizers.PATTERN), RANKS),
    }


def test_every_row_comes_out(docs):
    n = docs.count()
    for name, df in outputs(docs).items():
        rows = df.collect()
        assert len(rows) >= n if name == "packing" else len(rows) == n, name
        names = [c.lower() for c in df.columns]
        assert len(names) == len(set(names)), name
        assert "n_chars" in names, name


def test_empty_tables(docs):
    for name, df in outputs(docs.limit(0)).items():
        assert df.count() == 0, name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(docs.sparkSession, docs.limit(0), "").count() == 0


def test_stages_keep_columns(docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(docs.sparkSession, docs, "")
        assert out.columns == docs.columns, name
        out.collect()


def test_one_of_each_and_components(docs):
    found = simhash.near_duplicates(docs).collect()
    first = {r.doc_id: r.component_id for r in found}
    assert first[1] == first[2] == 1
    assert first[3] == first[4] == first[5] == 3  # no words: fingerprint zero
    assert {r.fingerprint for r in found if r.doc_id in (3, 4, 5)} == {"0" * 16}
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3, 6, 7]


def test_simhash_blocks_equal_brute_force(spark):
    ready(spark)
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {0}
    for c in centres:
        for _ in range(60):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    a = np.array(fps, dtype=np.uint64)
    root = list(range(len(a)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 4) + i + 1:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    want = {}
    for i in range(len(a)):
        want.setdefault(find(i), set()).add(signed[i])
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for block in (8, 8192):  # overlong entries are cut into blocks; short ones are not
        got = {}
        for r in graph.components(simhash.links(df, 4, block)).collect():
            got.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_embeddings_edges(spark):
    ready(spark)
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0),
        (4, [1.0, 0.0], 1), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0),
        (9, [None, 1.0], 0), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 0), (12, [], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(df).collect()}
    linked = {(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)}
    assert got == linked | {(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)}
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_chunks_equal_brute_force(spark):
    ready(spark)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    x = np.concatenate([b + 0.08 * rng.normal(size=(12, 8)) for b in base])
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    same = np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2
    want = ((unit @ unit.T >= 0.98) & same).sum(1) - 1
    got = {r.vec_id: r.n_links for r in covertree.near_duplicates(df, chunk=20).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_chat_layouts_and_escapes(spark):
    ready(spark)
    records = [
        '{"prompt":"a<|im_end|>\\n\\\\","response":"</s>[INST]"}',
        '{"instruction":"do","output":"done"}',
        '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":null}]}',
        '{"messages":[{"role":"user\\nx","content":"<|im_start|>"}]}',
        '{"other":1}', "no json", None,
    ]
    df = spark.createDataFrame([(r,) for r in records], "record string")
    made = chat.formatted(chat.canonical(df)).withColumn("back", chat.read_back(F.col("formatted")))
    rows = made.withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_mask"))).collect()
    assert [r.layout for r in rows] == ["prompt", "instruction", "conversations", "messages", None, None, None]
    assert all(r.turns == r.back for r in rows)
    assert rows[0].loss == "</s>[INST]" and "</s>[INST]" not in rows[0].formatted
    assert rows[4].formatted is None


def test_bpe_equals_definition_and_edits(spark):
    encoder = byte_bpe.loaded(RANKS)
    draw = random.Random(3)
    for _ in range(200):
        data = bytes(draw.choice(b"abest n\xc3\xa9-1") for _ in range(draw.randrange(1, 30)))
        if data not in encoder.ranks:
            assert encoder.encode(data) == encoder.merged(data)
    for _ in range(200):
        old = "".join(draw.choice("ab \n't1=") for _ in range(draw.randrange(30)))
        text = byte_bpe.Text(encoder, public_tokenizers.PATTERN, old)
        i = draw.randint(0, len(old))
        new = old[:i] + draw.choice(["", "x", " ", "\n\n", "st 1"]) + old[min(len(old), i + 2) :]
        text.edit(i, min(len(old), i + 2), new[i : len(new) - len(old[min(len(old), i + 2) :])])
        assert text.text == new
        assert text.ids() == byte_bpe.Text(encoder, public_tokenizers.PATTERN, new).ids()


def test_plan_fills_bins():
    draw = random.Random(2)
    counts = {draw.randint(1, 40): draw.randint(20, 50) for _ in range(60)}
    made = packing.plan(counts, 100)
    total = sum(n * c for n, c in counts.items())
    assert -(-total // 100) <= made.bins <= -(-total // 100) + 1


def test_base_spans_of_a_text():
    text = "a@b.co_x@y.zz 1.2.3.4 999.1.1.1 +1 (227) 555-6608"
    assert [s[0] for s in pii.base_spans(text)] == ["email", "email", "ip", "phone"]


def test_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_word_ids_equal_the_tokenizer():
    import struct

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [
        "ΣΑΣ. Σ, İ. İİ. ẞ ﬁn é, Ǆa.. ... , a., ª ⓐ Ⅷ. don't 12. x­. \r\x0b",
        "中文。, ÀÉ.\n\n \t tab</s>[INST]",
        "", None, "Word word, WORD. word", "été été.",
    ]
    found = packing.WordIds(path)
    for got, text in zip(found.ids(texts), texts):
        ids = found.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_fill_sequences_without_gaps(docs):
    rows = packing.packed(packing.pieces(docs, WORDS, capacity=64), 64).toPandas()
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]]
        assert group["length"].sum() <= 64


def test_base_score_equals_its_definition(spark, docs):
    import math
    from collections import Counter

    training = docs.filter("doc_id IS NULL OR doc_id <> 1")
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    seen = Counter(w for r in training.collect() for w in tokens(r["text"]))
    total = sum(seen.values())
    model, words = ppm.fit(training)
    found = ppm.scored(docs.withColumn("t", F.col("text")), model, words).collect()
    for r in found:
        mine = tokens(r["t"])
        score = math.fsum(math.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in mine)
        assert r["base_score"] == pytest.approx(score)
        assert (r["n_tokens"], r["train_tokens"]) == (len(mine), total)
        assert r["n_known"] == sum(seen[w] > 0 for w in mine)


def test_bytes_next_sum_to_one(docs):
    """Over all 256 bytes, the probabilities after any context add up to one."""
    model, _ = ppm.fit(docs)
    trie = ppm.Trie(model.levels)
    for context in (b"\0\0\0\0", b"the ", b"cat ", b"qqqq", b"q th"):
        grams = [int.from_bytes(context, "big") << 8 | b for b in range(256)]
        assert (10 ** trie.logs(np.array(grams, dtype=np.int64))).sum() == pytest.approx(1.0)


def test_blocks_of_a_hot_group_are_dealt_apart(spark, plan_of):
    """Also where the table of sizes is joined by sorting, not sent."""
    ready(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = spark.createDataFrame([(1, i, "w " * 30) for i in range(40)], "root long, node long, text string")
        plan = plan_of(shingles.links(members, block=200), "simple")
        first = next(line for line in plan.splitlines() if "hashpartitioning(root" in line)
        assert "i#" in first and "j#" in first
        prints = spark.createDataFrame([(i,) for i in range(40)], "fp long")
        plan = plan_of(simhash.links(prints, block=4), "simple")
        first = next(line for line in plan.splitlines() if "hashpartitioning(bit" in line)
        assert "i#" in first and "j#" in first
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_copies_are_proposed_by_simhash(spark):
    """Nodes whose fingerprints differ in at most four bits are tied, whatever their minimum hashes."""
    ready(spark)
    far = 0b1111100000
    prints = [(1, 0), (2, 0), (3, 0b1111), (4, 0b11111 << 40), (5, (0b11111 << 40) | far), (6, -1), (7, -1 - (1 << 62))]
    rows = spark.createDataFrame([*prints, (3, 0b1111)], "_node long, _fp long")
    pairs = {(r.a, r.b) for r in graph.components(shingles.alike(rows)).select(F.col("node").alias("a"), F.col("root").alias("b")).collect()}
    assert pairs == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}
    texts = [(i, PLAIN * 3 + f"{w}") for i, w in enumerate(("one", "two", "three"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = shingles.with_bands(docs, "text").collect()
    assert [np.uint64(r._fp & (2**64 - 1)) for r in found] == [np.uint64(simhash.fingerprint(t, 5)) for _, t in texts]
    assert [r.doc_id for r in shingles.one_of_each(docs).collect()] == [0]


def test_tokens_and_numbers_of_pieces_come_from_different_tasks(docs, plan_of, monkeypatch):
    """Workers that tokenize keep the words they have met; two kinds of them in a task are twice as many."""
    plans, ranked = [], packing.ranked
    monkeypatch.setattr(packing, "ranked", lambda rows, *how: plans.append(plan_of(rows, "simple")) or ranked(rows, *how))
    pieces = packing.pieces(docs.select("doc_id", "text"), WORDS)
    assert packing.packed(pieces).count() == pieces.count()
    assert len(plans) == 1 and "Python" not in plans[0]


def test_operators_without_tables_let_go_of_earlier_ones(monkeypatch):
    """Else a worker keeps the tables of one stage of the pipeline through the next ones."""
    import pandas as pd

    none = pd.DataFrame({"node": [], "text": [], "lang": [], "term": [], "n": [], "bit": [], "rest": [], "fp": []})
    for begin in (langid._words, langid._grams, simhash._linked(4, 10), lambda frames: [shingles._linked(none)]):
        monkeypatch.setattr(common, "_held", {})
        common.held("words", lambda: "large")
        list(begin(iter([])))
        assert not common._held


def test_unseen_words_are_scored_by_one_worker_of_a_task(spark, plan_of, monkeypatch):
    """Each worker that scores has the model's tables; two of them in a task are twice as many."""
    rows = [("the thing is here and the dog is there", "en")] * 40 + [("der schatz ist schwarz", "de")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), kept_words=4)
    plans, written = {}, langid.written
    monkeypatch.setattr(
        langid, "written", lambda df, name: plans.update({name: plan_of(df, "simple")}) or written(df, name)
    )
    docs = spark.createDataFrame([(1, "theth schatzer"), (2, "\u6f22"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in langid.identified(docs, model).collect()}
    assert found == {1: "de", 2: "en", 3: langid.UNKNOWN}
    assert plans["partly"].count("ArrowEvalPython") == plans["looked_up"].count("ArrowEvalPython") == 1


def test_tables_of_grams_take_little_more_than_their_numbers(spark):
    """As lists of numbers they took several times as much in every worker."""
    import tracemalloc

    terms = [a + b + c + d for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefgh" for d in "abcdefgh"]
    langs = [f"l{i:02}" for i in range(20)]
    counts = {"word": ([], [], []), "gram": ([langs[i % 20] for i in range(len(terms))], terms, [1] * len(terms))}
    sizes = {size: (len(terms), [len(terms) // 20] * 20) for size in range(5)}
    model = langid.Model(counts, langs, sizes, True, True)
    tracemalloc.start()
    try:
        scorer = langid.Scorer(model)
        taken = tracemalloc.get_traced_memory()[0] - scorer.table.nbytes
    finally:
        tracemalloc.stop()
    assert taken < 2.5 * 8 * 20 * len(terms)

"""Learned and balancing operators against held-out rows, laws and plain versions."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import langid, quality, sharding
from matchlens.llm.common import held_out, ready, table


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = table(ready(spark), sf_dir, "documents")
    apart = held_out("doc_id", 5, 0)
    model = langid.fit(docs.filter(~apart))
    rows = langid.identified(docs.filter(apart), model).filter("text rlike '[a-zA-Z]'").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 20 and right >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_unseen_words(spark):
    ready(spark)
    rows = [("the thing is nothing", "en"), ("der schatz ist schwarz", "de")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    scorer = langid.Scorer(model)
    assert scorer.predict("theth")[0] == "en" and scorer.predict("schatzer")[0] == "de"
    assert scorer.predict("12 34 !") == (langid.UNKNOWN, 0.0) == scorer.predict(None)


@pytest.mark.parametrize("shards", [1, 8])
def test_shards_are_even_and_gapless(spark, shards):
    """Also with a text that a third of all rows share."""
    ready(spark)
    draw = np.random.default_rng(4)
    texts = ["x" * int(n) for n in draw.lognormal(5, 1, 4000)] + ["the same text for many rows"] * 2000
    rows = [(i, f"{t}{i}" if i < 4000 else t) for i, t in enumerate(texts)] + [(None, None), (9999, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(docs, shards).collect()
    assert len(got) == len(rows)
    size, slots, text = defaultdict(int), defaultdict(list), dict(rows)
    for r in got:
        content = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(content) + 1, zlib.crc32(content))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 0.01 * sum(size.values()) / shards


def test_fences_equal_their_definition(spark):
    """Sketches of small groups are exact; a group too small uses its language, another everything."""
    ready(spark)
    draw = np.random.default_rng(6)
    words = [f"w{i}" + "ab" * (i % 4) for i in range(400)]
    rows = []
    for i in range(600):
        lang, source = [("en", "a"), ("en", "b"), (None, "a")][i % 3] if i < 570 else [("en", "c"), ("xx", "c")][i % 2]
        text = draw.choice(words, 80, replace=False).tolist()
        text += ["#|#"] * int(draw.choice([0, 1, 3, 60], p=[0.5, 0.3, 0.15, 0.05]))
        text = " ".join(text) + ("\nend\nend\nend" if i % 11 == 0 else "")
        rows.append((i, text, lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.judged(docs).collect()
    sound = [r for r in got if not r["base_failed"]]
    assert 0 < sum(r["kept"] for r in got) < len(sound)

    def group(r):
        own = [s for s in sound if (s["lang"], s["source"]) == (r["lang"], r["source"])]
        by_lang = [s for s in sound if s["lang"] == r["lang"]]
        return next(g for g, least in ((own, 100), (by_lang, 100), (sound, 1)) if len(g) >= least)

    def at(group, measure, q):
        return sorted(s[measure] for s in group)[int(np.ceil(q * len(group))) - 1]

    for r in got:
        inside = not r["base_failed"]
        for measure, least in quality.SPREADS.items():
            low, high = at(group(r), measure, 0.25), at(group(r), measure, 0.75)
            room = quality.REACH * max(high - low, least)
            inside = inside and r[measure] <= high + room
            if measure == "word_length":
                inside = inside and r[measure] >= low - room
        assert r["kept"] == inside, r["doc_id"]


def test_fences_of_merged_sketches_are_near(spark):
    """Beyond the exact size, quartiles stay within one per cent of the ranks."""
    ready(spark)
    rows = spark.range(0, 40_000, 1, 16).select(
        F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(False).alias("base_failed"),
        *[(F.xxhash64("id", F.lit(m)) % 1000 / 1000.0).alias(m) for m in quality.SPREADS],
    )
    one = quality.fences(rows).first()
    for m, least in quality.SPREADS.items():
        values = np.sort([r[0] for r in rows.select(m).collect()])
        low, high = values[10_000], values[30_000]
        room = quality.REACH * max(high - low, least)
        assert one[f"{m}_high"] == pytest.approx(high + room, abs=0.02 * (2 * quality.REACH + 1))
        assert one[f"{m}_low"] == pytest.approx(low - room, abs=0.02 * (2 * quality.REACH + 1))

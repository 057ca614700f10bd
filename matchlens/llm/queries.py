"""The registered queries of this folder, each beside the SQL it is checked with, if any."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm import byte_bpe, chat, covertree, divergence, fingerprints, langid, packing, pii, ppm, quality
from matchlens.llm import runs, sharding, simhash
from matchlens.llm.common import held_out, ready, table

LANG_FOLDS, LANG_FOLD = 5, 0
LM_FOLDS, LM_FOLD = 7, 2


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judged(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, keep_text=False)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ready(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    rows = rows.unionByName(spark.createDataFrame(more, rows.schema))
    made = chat.formatted(chat.canonical(chat.records_of(rows)))
    turns, loss = chat.read_back(F.col("formatted")), chat.masked(F.col("formatted"), F.col("loss_mask"))
    read = made.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(ready(spark), sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return covertree.near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    rows = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(rows).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    found = sharding.sharded(docs, shards=8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select(
        "doc_id", "text", held_out("doc_id", LM_FOLDS, LM_FOLD).alias("held_out")
    )
    model, words = ppm.fit(docs.filter("not held_out"))
    return ppm.scored(docs, model, words).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select(
        "doc_id", "text", "lang", held_out("doc_id", LANG_FOLDS, LANG_FOLD).alias("held_out")
    )
    model = langid.fit(docs.filter("not held_out"))
    return langid.identified(docs.drop("lang"), model, keep_text=False)


def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.with_ids(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return byte_bpe.with_decoded(encoded, ranks).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of every tenth id from some place on replaced by a repeated stretch."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("g", F.floor(h / 10)).withColumn("chosen", F.coalesce(h % 10 == 0, F.lit(False)))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    # Only chosen texts are cut into words here.
    rows = docs.withColumn("words", F.when(F.col("chosen"), words)).withColumn("n", F.size("words"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    rows = rows.withColumn("a", a.cast("int"))
    rows = rows.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    stretch = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    made = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), stretch), F.lit(1), F.col("n"))
    text = F.when(F.col("chosen") & (F.col("n") > 0), F.array_join(made, " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    found = runs.with_runs(planted(docs)).drop("text").withColumn("best", runs.strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("text", "lang", "source")
    found = divergence.divergence(divergence.term_counts(docs))
    return found.withColumn("rank", F.col("rank").cast("int"))


SOURCE_DIVERGENCE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        coalesce(text, '') AS text FROM documents
), words AS (
    SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), vocabulary AS (
    SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), sizes AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang
), sources AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN vocabulary USING (lang, term)
    GROUP BY lang, source, term
), totals AS (
    SELECT s.lang, s.source, coalesce(sum(n), 0) AS total FROM sources s LEFT JOIN counts USING (lang, source)
    GROUP BY s.lang, s.source
), shares AS (
    SELECT t.lang, t.source, o.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * z.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (o.n + 5)) // (z.total + 5 * z.v)::HUGEINT AS q
    FROM totals t JOIN vocabulary o ON t.lang = o.lang JOIN sizes z ON t.lang = z.lang
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = o.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
), every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    found = fingerprints.near_duplicates(docs, keep_text=False)
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", digits("fingerprint"), digits("edited_fingerprint"),
        "near_edited", "near_next", "class_id",
    )


QUERIES = {
    "op1_quality_rules": quality_rules,
    "op2_personal_data": personal_data,
    "op3_simhash": simhash_near_dedup,
    "op4_chat_formatting": chat_formatting,
    "op5_cover_tree": embedding_near_dedup,
    "op6_best_fit_packing": best_fit_packing,
    "op7_vector_sharding": vector_sharding,
    "op8_ppm": ppm_scores,
    "op9_language_id": language_id,
    "op10_byte_bpe": byte_bpe_round_trip,
    "op11_periodic_runs": periodic_runs,
    "op12_source_divergence": source_divergence,
    "op13_minhash": document_fingerprints,
}
# The others are learned, hashed or tokenized: tests hold them against definitions.
CHECKS: dict[str, str] = {"op12_source_divergence": SOURCE_DIVERGENCE}

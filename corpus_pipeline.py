"""From raw documents to packed training sequences.

``STAGES`` are applied in order; each takes what the one before it kept, is
written as Parquet and read again. The first four return the columns of
documents, the last one a row for each piece and its place in a sequence. The
intermediate tables of a stage are removed when the next one starts.

1. ``language``: documents whose language cannot be told go.
2. ``quality``: documents that break a base rule or leave the fences of their
   language and source go.
3. ``near_duplicates``: one document of each group of near copies stays. SimHash
   fingerprints over five-word shingles, met through segments with one bit blotted
   out, and minimum hashes propose; a Jaccard similarity of 0.8 or more decides.
4. ``personal_data``: identifiers are replaced by their kind.
5. ``packing``: token pieces are packed into sequences of 4096.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchlens.llm import langid, packing, pii, quality, shingles
from matchlens.llm.common import held_out, ready, removed, stage, table, written

LANG_FOLDS, LANG_FOLD = 5, 0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(~held_out("doc_id", LANG_FOLDS, LANG_FOLD)))
    return langid.accepted(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(rows)


STAGES = [
    ("language", stage(0, language)),
    ("quality", stage(1, quality_rules)),
    ("near_duplicates", stage(2, near_duplicates)),
    ("personal_data", stage(3, personal_data)),
    ("packing", stage(4, best_fit_packing)),
]

# Learned models, hashes, components and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, function in STAGES:
        docs = written(function(spark, docs, sf_dir), f"stage_{name}")
    removed(spark, docs, len(STAGES))
    return docs

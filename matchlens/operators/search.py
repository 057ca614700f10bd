"""Name search by a posting table of trigrams: intersect the lists of a term, then verify."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.operators.reports import search_players

GRAM = 3


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-cased text; none of a shorter one."""
    low = F.lower(text)
    last = F.length(low) - GRAM + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM))))


def write_postings(rows: DataFrame, path: str, key: str, name: str = "player_name") -> None:
    """``gram`` and ``key``, sorted by gram, so that a search skips row groups without its grams.

    A gram that most names share lies in several files: ranges go by gram and key.
    """
    posted = rows.select(F.explode(grams(F.col(name))).alias("gram"), F.col(key)).distinct()
    posted.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write.mode("overwrite").parquet(path)


def search_postings(
    spark: SparkSession, rows: DataFrame, path: str, term: str | None, key: str, name: str = "player_name"
) -> DataFrame:
    """The same rows as ``search_players``; terms of fewer than three characters scan all rows."""
    low = (term or "").lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return search_players(rows, term)
    posted = spark.read.parquet(path).filter(F.col("gram").isin(wanted))
    # Several names of one key share its grams, so the name itself is looked at in the end.
    all_of_them = posted.groupBy(key).agg(F.count("*").alias("hits")).filter(F.col("hits") == len(wanted))
    return rows.join(all_of_them.select(key), key, "left_semi").filter(F.lower(name).contains(low))

"""Missing values and columns that no derived table has."""

import pytest
from pyspark.sql import functions as F

from matchlens.functions import sql
from matchlens.functions.numbers import clamp
from matchlens.operators.reports import headers, printed
from matchlens.skew import salted_join
from matchlens.streaming.live import latest


def test_clamp_keeps_null(spark):
    sql.register(spark)
    df = spark.sql("SELECT * FROM VALUES (CAST(NULL AS DOUBLE)), (2D), (0.5D) AS t(x)")
    rows = df.select(clamp(F.col("x"), 0.01, 0.99).alias("a"), F.expr("clamp(x, 0.01D, 0.99D)").alias("b")).collect()
    assert [tuple(r) for r in rows] == [(None, None), (0.99, 0.99), (0.5, 0.5)]


def test_absent_report_column_prints_as_missing(spark):
    keys = list(headers("NFL", "advanced").values())
    df = spark.createDataFrame([("a",)], "team string")
    row = printed(df, "NFL", "advanced", ["team"]).first()
    assert all(row[k] == "–" for k in keys if k != "team")


def test_latest_carries_maps(spark):
    df = spark.sql(
        "SELECT 1 AS id, 1 AS seq, map('home', -110) AS moneyline UNION ALL SELECT 1, 2, map('home', -120)"
    )
    assert latest(df, ["id"], ["seq"]).first().moneyline == {"home": -120}


def test_salted_join_rejects_outer_dimensions(spark):
    df = spark.range(2)
    with pytest.raises(ValueError):
        salted_join(df, df, ["id"], ["id"], how="right")

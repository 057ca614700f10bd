"""Scalar expressions on their awkward inputs."""

import pytest
from pyspark.sql import functions as F

from matchlens.functions import numbers, odds, sql, texts, times

NAN, INF = float("nan"), float("inf")


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_numbers_in_text(spark):
    rows = ["150", "-150", " +130 ", "1e3", ".5", "5.", "", "  ", "N/A", "150d", "Infinity", "NaN", "1e999", None]
    want = [150, -150, 130, 1000, 0.5, 5, 0, 0, None, None, None, None, None, None]
    assert values(spark, rows, "string", numbers.to_finite) == want
    want[6] = None  # only the empty text is missing; blanks still count as zero
    assert values(spark, rows, "string", numbers.to_num) == want


def test_finite(spark):
    got = values(spark, [1.5, NAN, INF, -INF, None], "double", numbers.finite)
    assert got == [1.5, None, None, None, None]


def test_american_odds(spark):
    rows = ["150", "-150", "0", "N/A", "", None]
    prob = values(spark, rows, "string", lambda v: odds.american_to_prob(odds.american(v)))
    assert prob == [0.4, 0.6, None, None, None, None]
    pay = values(spark, rows, "string", lambda v: odds.payout(odds.american(v)))
    assert pay == [1.5, pytest.approx(2 / 3), None, None, None, None]


def test_devig(spark):
    df = spark.createDataFrame([(0.6, 0.5), (0.0, 0.0), (None, 0.5)], "a double, b double")
    got = [r[0] for r in df.select(odds.devig(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.6 / 1.1), None, None]


def test_normal_cdf(spark):
    got = values(spark, [0.0, 0.5, -1.25, 3.0], "double", odds.std_norm_cdf)
    assert got == pytest.approx([0.499999976, 0.691462453, 0.105649844, 0.998650033], abs=5e-10)


def test_z_for_tiering_minimum(spark):
    got = values(spark, [0.0, 0.1, -0.1, 2.0], "double", odds.z_for_tiering)
    assert got[0] == 0.25 and got[1] == got[2] and min(got) == 0.25


def test_fixed_decimals_follow_the_binary_value(spark):
    rows = [1.005, 0.25, 1.45, -0.04, 2.5, 99.95, -2.5, 0.0, None]
    fixed = lambda d: values(spark, rows, "double", lambda v: numbers.to_fixed(v, d))
    assert fixed(0) == ["1", "0", "1", "-0", "3", "100", "-3", "0", None]
    assert fixed(1) == ["1.0", "0.3", "1.4", "-0.0", "2.5", "100.0", "-2.5", "0.0", None]
    assert fixed(2) == ["1.00", "0.25", "1.45", "-0.04", "2.50", "99.95", "-2.50", "0.00", None]


def test_fixed_decimals_against_exact_arithmetic(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rows = [i / 1000 for i in range(-3000, 3000, 7)] + [i / 20 for i in range(200)]
    for d in (0, 1, 2):
        want = [
            ("-" if x < 0 else "") + str(abs(Decimal(x)).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP))
            for x in rows
        ]
        assert values(spark, rows, "double", lambda v: numbers.to_fixed(v, d)) == want


def test_cells(spark):
    cell = lambda key, rows, kind="double", **k: values(
        spark, rows, kind, lambda v: numbers.format_cell(v, key, **k)
    )
    assert cell("three_pct", [0.3456, None, -INF]) == ["34.6%", "–", "–"]
    assert cell("srs", [3.25]) == ["3.3"]
    assert cell("gp", [16.5]) == ["17"]
    assert cell("win_pct", [0.6]) == ["0.6"]
    df = spark.sql("SELECT '31:05' AS top, CAST(16 AS BIGINT) AS gp, CAST(NULL AS STRING) AS none")
    shown = df.select(
        numbers.format_cell(F.col("top"), "avgTimeOfPossession", "text"),
        numbers.format_cell(F.col("gp"), "gp", "whole"),
        numbers.format_cell(F.col("gp"), "srs", "whole"),
        numbers.format_cell(F.col("none"), "team_name", "text"),
    )
    assert list(shown.first()) == ["31:05", "16", "16.0", "–"]


def test_odd_text(spark):
    assert values(spark, [130.0, -150.0, 0.0, None, 1.5], "double", odds.format_odd) == [
        "+130", "-150", "N/A", "N/A", "+1.5",
    ]
    text = values(spark, ["130", "0", None], "string", lambda v: odds.format_odd(v, text=True))
    assert text == ["+130", "0", "N/A"]


def test_percent_and_edge_text(spark):
    assert values(spark, [0.125, 0.704], "double", numbers.pct) == ["13%", "70%"]
    assert values(spark, [12.53, -0.04, 0.0], "double", numbers.edge_fmt) == ["+12.5%", "-0.0%", "+0.0%"]
    assert values(spark, [1234567.0, 1234.5678], "double", numbers.grouped) == ["1,234,567", "1,234.568"]
    assert values(spark, [0.0625, 1234.5625, -0.0625], "double", numbers.grouped) == ["0.063", "1,234.563", "-0.063"]


def test_names(spark):
    assert values(spark, ["New  York Jets", None], "string", texts.canonical) == ["newyorkjets", ""]
    assert texts.snake_to_camel("avg_third_down_pct") == "avgThirdDownPct"
    df = spark.sql("SELECT map('team_id', 1, 'srs', 2, 'avg_x_y', 3) AS m")
    assert df.select(texts.camel_keys(F.col("m"))).first()[0] == {"teamId": 1, "srs": 2, "avgXY": 3}


def test_loose_json(spark):
    rows = ['{"home":-150,"x":{"y":1.5}}', '"{\\"home\\":\\"+130\\"}"', "not json", '"text"', "5", "", None]
    home = lambda v: texts.pick(texts.parse_loose(v), "$.home", "$.x.y")
    assert values(spark, rows, "string", home) == ["-150", "+130", None, None, None, None, None]


def test_instants(spark):
    rows = ["2024-07-01T23:05:00Z", "2024-07-01T19:05:00-04:00", "2024-07-01 23:05:00", "soon", None]
    got = values(spark, rows, "string", times.parse_instant)
    assert [str(g) for g in got] == ["2024-07-01 23:05:00"] * 3 + ["None", "None"]
    shown = values(spark, rows, "string", lambda v: times.clock(times.parse_instant(v)))
    assert shown == ["7:05 PM"] * 3 + [None, None]


def test_times_do_not_depend_on_the_session_zone(spark):
    ask = lambda: values(
        spark, ["2024-01-01T04:30:00Z"], "string", lambda v: F.concat_ws(
            " ", times.clock(times.parse_instant(v)), times.eastern_date(times.parse_instant(v))
        )
    )
    here = ask()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert ask() == here == ["11:30 PM 2023-12-31"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_default_season(spark):
    df = spark.createDataFrame(
        [("NBA", "2024-10-21"), ("NBA", "2024-10-22"), ("NFL", "2024-09-10"), ("MLB", "2024-04-01")],
        "s string, d string",
    )
    season = times.default_season(F.col("s"), F.col("d").cast("date"))
    got = [tuple(r) for r in df.select(season, times.season_label(F.col("s"), season)).collect()]
    assert got == [(2023, "2023-24"), (2024, "2024-25"), (2023, "2023"), (2024, "2024")]


def test_sql_functions_agree_with_columns(spark):
    sql.register(spark)
    rows = [150.0, -150.0, 0.0, None, 3.0, -0.4]
    pairs = {
        "american_to_prob": odds.american_to_prob, "payout": odds.payout, "std_norm_cdf": odds.std_norm_cdf,
        "z_for_tiering": odds.z_for_tiering, "expected_margin": odds.expected_margin,
    }
    for name, column in pairs.items():
        via_sql = values(spark, rows, "double", lambda v: F.call_function(name, v))
        assert via_sql == pytest.approx(values(spark, rows, "double", column)), name
    text = ["", "12", "x", None]
    assert values(spark, text, "string", lambda v: F.call_function("to_finite", v)) == [0.0, 12.0, None, None]
    got = spark.sql(
        "SELECT devig(0.6D, 0.6D), margin_sigma('NFL'), margin_sigma('NHL'), clamp(2D, 0D, 1D), canonical(' A b')"
    ).first()
    assert tuple(got) == (0.5, 13.0, 10.0, 1.0, "ab")


def test_weather_precedence(spark):
    df = spark.createDataFrame(
        [(True, "70", "5"), (False, "70", "5"), (False, None, None)], "i boolean, t string, w string"
    )
    got = [r[0] for r in df.select(texts.weather_label(F.col("i"), F.col("t"), F.col("w"))).collect()]
    assert got == ["Indoor", "70°F / 5mph", "N/A"]


def test_number_text_is_plain(spark):
    rows = [12345678.5, 0.0005, -0.25, 3.0, 0.0, 1e16, 1e-9, None]
    want = ["12345678.5", "0.0005", "-0.25", "3", "0", "10000000000000000", "1.0E-9", None]
    assert values(spark, rows, "double", numbers.number_text) == want
    assert values(spark, [1.5e17], "double", lambda c: numbers.to_fixed(c, 1)) == ["150000000000000000.0"]

"""Skew helpers against brute force, on data where one key holds a third of the rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchlens import skew
from matchlens.operators import features, joins
from matchlens.sources import tables
from matchlens.streaming import live


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    keys = ["hot"] * 400 + [f"k{rng.randrange(60)}" for _ in range(800)]
    return [(k, rng.randrange(1000), i, rng.randrange(-5, 6)) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, i long, v long").repartition(5)


def ordered(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups[row[0]].append(row)
    return groups


def test_blocks_cut_the_hot_key(frame, many_blocks):
    blocks = skew.sorted_blocks(frame, ["k", "t", "i"])
    assert blocks.count > 2
    spread = blocks.rows.filter("k = 'hot'").select("_block").distinct().count()
    assert spread > 1
    sizes = [r["count"] for r in blocks.rows.groupBy("_block").count().collect()]
    assert max(sizes) < 0.5 * sum(sizes)
    assert sorted(r[0] for r in blocks.rows.select("_pos").collect()) == list(range(1200))


def test_positions(frame, rows, many_blocks):
    got = {r["i"]: r["position"] for r in skew.positions(frame, ["k"], ["t", "i"]).collect()}
    want = {r[2]: n for group in ordered(rows).values() for n, r in enumerate(group, 1)}
    assert got == want


@pytest.mark.parametrize("depth", [1, 5, 700])
def test_carry_completes_look_backs(frame, rows, many_blocks, depth):
    blocks = skew.sorted_blocks(frame, ["k", "t", "i"])
    window = skew.in_block(["k"]).rowsBetween(-depth, -1)
    out = blocks.with_carry(depth).withColumn("s", F.sum("v").over(window)).filter("NOT _carried")
    got = {r["i"]: r["s"] for r in out.collect()}
    want = {}
    for group in ordered(rows).values():
        for n, r in enumerate(group):
            before = [x[3] for x in group[max(0, n - depth) : n]]
            want[r[2]] = sum(before) if before else None
    assert got == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_totals(frame, rows, many_blocks, inclusive):
    blocks = skew.sorted_blocks(frame, ["k", "t", "i"])
    out = blocks.running(["k"], inclusive=inclusive, total=("sum", "v"), top=("max", "v"))
    got = {r["i"]: (r["total"], r["top"]) for r in out.collect()}
    want = {}
    for group in ordered(rows).values():
        for n, r in enumerate(group):
            seen = [x[3] for x in group[: n + int(inclusive)]]
            want[r[2]] = (sum(seen), max(seen) if seen else None)
    assert got == want


def test_one_key_over_all_blocks(spark, many_blocks):
    df = spark.range(500).select(F.lit("only").alias("k"), F.col("id").alias("i"), F.lit(1).cast("long").alias("v"))
    out = skew.sorted_blocks(df, ["k", "i"]).running(["k"], total=("sum", "v"))
    assert all(r["total"] == r["i"] + 1 for r in out.collect())


def test_empty_input(spark, frame):
    assert skew.positions(frame.filter("false"), ["k"], ["t", "i"]).count() == 0


def test_hot_keys_are_found_and_bounded(frame):
    hot = skew.hot_keys(frame, ["k"], share=0.05, min_rows=1)
    hot_hash = frame.filter("k = 'hot'").select(F.xxhash64("k")).first()[0]
    found = dict(hot)
    assert hot_hash in found and found[hot_hash] >= 6
    assert len(found) <= 20
    assert skew.hot_keys(frame, ["k"], share=0.05, min_rows=10_000) == []
    assert skew.hot_keys(frame.filter("false"), ["k"], share=0.05, min_rows=1) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_keeps_every_match(spark, frame, how, plan_of):
    dims = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("gone", 4)], "k string, d int")
    plain = frame.join(dims, ["k"], how)
    salted = skew.salted_join(frame, dims, ["k"], spread=["i"], how=how, share=0.05, min_rows=1)
    assert "_salt" in plan_of(salted)
    columns = plain.columns
    assert salted.columns == columns
    assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_salted_join_without_hot_keys_is_a_plain_join(spark, frame, plan_of):
    dims = spark.createDataFrame([("k1", 3)], "k string, d int")
    assert "_salt" not in plan_of(skew.salted_join(frame, dims, ["k"], spread=["i"]))


# The operators built on these give the same rows whether data fits one block or not.


@pytest.fixture(scope="module")
def hot_games(spark, sf_dir):
    """Every third game is played at home by one team, and all are finished."""
    g = tables.games(spark, sf_dir)
    hot = F.col("game_id") % 3 == 0
    g = g.withColumn("home_team", F.when(hot, "HOT").otherwise(F.col("home_team")))
    points = F.col("game_id") % 7
    return g.withColumns(
        {"sport": F.lit("NBA"), "home_final": F.coalesce("home_final", points + 20), "away_final": F.coalesce("away_final", points * 5)}
    )


OPERATORS = {
    "form": lambda s, d, g: features.rolling_form(features.team_games(g)),
    "rest": lambda s, d, g: features.rest_days(features.team_games(g)),
    "h2h": lambda s, d, g: features.head_to_head(g),
    "streak": lambda s, d, g: features.current_streak(features.team_games(g)),
    "connectivity": lambda s, d, g: live.connectivity(
        tables.probes(s, d).withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    ),
    "sessions": lambda s, d, g: live.sessions(
        tables.events(s, d).withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    ),
    "quotes": lambda s, d, g: joins.quotes_before_start(
        tables.quotes(s, d).withColumn("game_id", F.when(F.col("quote_id") % 3 == 0, 7).otherwise(F.col("game_id"))),
        tables.replayed_starts(g),
    ),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_do_not_depend_on_the_blocks(spark, sf_dir, hot_games, name, monkeypatch):
    run = lambda: sorted(map(tuple, OPERATORS[name](spark, sf_dir, hot_games).collect()), key=repr)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        single = run()
        spark.conf.set(key, "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        monkeypatch.setattr(skew.salted_join, "__defaults__", ("inner", 0.01, 5, None))
        assert run() == single
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert single

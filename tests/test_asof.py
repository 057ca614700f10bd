"""The as-of merge against a plain search, and the listed order of teams."""

import random

from pyspark.sql import functions as F

from matchlens.operators import asof, injuries


def plain(quotes, games):
    out = []
    for game, start in games:
        seen = [q for q in quotes if q[0] is not None and q[0] == game and q[1] is not None and start is not None and q[1] < start]
        last = max(seen, key=lambda q: (q[1], q[2]), default=(None, None, None, None))
        out.append((game, start, last[1], last[2], last[3], len(seen) or None))
    return sorted(out, key=repr)


def test_merge_equals_a_plain_search(spark, many_blocks):
    draw = random.Random(3)
    # One game holds most quotes; moments repeat; some keys and times are missing.
    quotes = [
        (draw.choice([1] * 8 + [2, 3, 9, None]), draw.choice([*range(20), None]), i, {"home": i} if i % 5 else None)
        for i in range(600)
    ]
    games = [(1, s) for s in (None, 0, 1, 7, 7, 19, 50)] + [(2, 10), (3, 0), (4, 10), (5, None), (None, 10)]
    left = spark.createDataFrame(quotes, "game_id long, quote_ts long, quote_id long, odds map<string,long>").repartition(7)
    right = spark.createDataFrame(games, "game_id long, start_ts long")
    found = asof.last_before(left, right)
    assert found.columns == ["game_id", "start_ts", "quote_ts", "quote_id", "odds", "quotes_seen"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(quotes, games)


def test_tables_without_rows(spark):
    quotes = spark.createDataFrame([], "game_id long, quote_ts long, quote_id long, ml double")
    games = spark.createDataFrame([(1, 5)], "game_id long, start_ts long")
    assert [tuple(r) for r in asof.last_before(quotes, games).collect()] == [(1, 5, None, None, None, None)]
    assert asof.last_before(quotes, games.limit(0)).count() == 0


def test_no_join_of_quotes_by_game(spark, plan_of):
    quotes = spark.range(50).select(
        F.lit(1).cast("long").alias("game_id"), F.col("id").alias("quote_ts"), F.col("id").alias("quote_id")
    )
    games = spark.createDataFrame([(1, 5)], "game_id long, start_ts long")
    joins = [line for line in plan_of(asof.last_before(quotes, games), "simple").splitlines() if "Join" in line]
    assert joins and all("_key" not in line or "_block" in line for line in joins)


def test_games_without_a_quote_do_not_share_a_task(spark):
    quotes = spark.createDataFrame([(1, 3, 1)], "game_id long, quote_ts long, quote_id long")
    games = spark.range(4000).select(F.col("id").alias("game_id"), F.lit(5).cast("long").alias("start_ts"))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in plain}
    try:
        for key, value in plain.items():
            spark.conf.set(key, value)
        tasks = asof.last_before(quotes, games).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(t["count"] for t in tasks) == 4000
    assert max(t["count"] for t in tasks) < 2000


def test_teams_are_listed_by_code_unit(spark):
    names = ["b", "B", "é", "z", "￮", "\U0001f600", ""]
    df = spark.createDataFrame([("NBA", 1, n) for n in names] + [("NFL", 1, "a")], "league string, report_date int, team string")
    rows = injuries.listed_teams(df).filter("league = 'NBA'").orderBy("position").collect()
    assert [r.team for r in rows] == sorted(names, key=lambda n: n.encode("utf-16-be"))
    assert [r.position for r in rows] == list(range(1, len(names) + 1))

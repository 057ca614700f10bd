"""Readers prune, tolerate bad payloads, and sinks replace only what they must."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from matchlens.operators import reconcile, slate, snapshots
from matchlens.sources import readers, sinks
from matchlens.sources.schemas import TABLES


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("league")

    def save(name, rows, partitions):
        df = spark.createDataFrame(spark.sparkContext.parallelize([json.dumps(r) for r in rows]).map(lambda x: (x,)), "v string")
        out = df.select(F.from_json("v", TABLES[name]).alias("r")).select("r.*")
        out.write.partitionBy(*partitions).parquet(str(path / name))

    day = lambda d: {"game_date": d}
    save(
        "schedule",
        [
            {"game_id": "1", "sport": "MLB", **day("2024-07-01"), "scheduled_time": "2024-07-01T23:05:00Z"},
            {"game_id": "2", "sport": "NFL", **day("2024-07-01"), "gameTimeUTC": "2024-07-01T17:00:00Z"},
            {"game_id": "3", "sport": "NBA", **day("2024-07-02")},
        ],
        ["sport", "game_date"],
    )
    save("player_stats", [
        {"player_id": "1", "player_name": "Ann Lee", "sport": "NBA", "season": 2024, "points": 10},
        {"player_id": "2", "player_name": "Bo Leeds", "sport": "NBA", "season": 2024, "points": 12},
        {"player_id": "3", "player_name": "Cy", "sport": "NBA", "season": 2023, "points": 1},
    ], ["sport", "season"])
    save("team_stats", [{"team_id": "1", "team_name": "A", "sport": "NBA", "season": 2024}], ["sport", "season"])
    save("nfl_summary", [{"team_id": "7", "team_name": "A", "season": "2023", "srs_lite": 1.5}], ["season"])
    save("adv_nfl", [{"team_name": "A", "season": 2023, "srs": 1.0}], ["season"])
    save("weather", [{"sport": "MLB", "home_team": "A", "temperature": 70}, {"sport": "NBA", "home_team": "A"}], ["sport"])
    save("snapshots", [{"game_id": "1", "sport": "MLB", "message": "none"}], ["sport"])
    save("features", [{"game_id": "1", "features": {"a": 1.0}}], ["game_id"])
    save("odds", [{"game_id": "1", "quote_id": 1, "ml_home": -110.0}], ["game_id"])
    save("historical", [{"game_id": "9", "sport": "MLB", **day("2024-06-30"), "home_final_score": 3}], ["game_date"])
    save("injuries", [{"id": "1", "player": "P", "league": "NFL", "report_date": "2024-07-01"}], ["league", "report_date"])
    return str(path)


def test_schedule(spark, root):
    mlb = readers.read_schedule(spark, root, "MLB", date(2024, 7, 1)).first()
    assert (mlb["game_id"], mlb["sport"], mlb["game_time_et"]) == ("1", "MLB", "7:05 PM")
    assert readers.read_schedule(spark, root, "NFL", date(2024, 7, 1)).first()["game_time_et"] == "1:00 PM"
    assert readers.read_schedule(spark, root, "NBA", date(2024, 7, 2)).first()["game_time_et"] == ""
    assert readers.read_schedule(spark, root, "NBA", None).count() == 0


def test_filters_prune_partitions(spark, root, plan_of):
    plan = plan_of(readers.read_schedule(spark, root, "MLB", date(2024, 7, 1)).select("game_id"))
    pruned = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "sport" in pruned and "game_date" in pruned
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "moneyline" not in schema


def test_other_readers(spark, root):
    names = lambda df: sorted(r["player_name"] for r in df.collect())
    assert names(readers.read_player_stats(spark, root, "NBA", 2024)) == ["Ann Lee", "Bo Leeds"]
    assert names(readers.read_player_stats(spark, root, "NBA", 2024, "LEED")) == ["Bo Leeds"]
    assert readers.read_team_stats(spark, root, "NBA", 2024).count() == 1
    assert readers.read_advanced(spark, root, "NFL", 2023).first()["srs"] == 1.0
    with pytest.raises(KeyError):
        readers.read_advanced(spark, root, "NHL", 2023)
    summary = readers.read_nfl_summary(spark, root, 2023)
    assert {"teamId", "teamName", "srs", "winPct"} <= set(summary.columns)
    assert (summary.first()["season"], summary.first()["srs"], summary.first()["teamId"]) == (2023, 1.5, "7")
    assert readers.read_nfl_summary(spark, root, None).count() == 0
    assert readers.read_weather(spark, root, "MLB", "A").count() == 1
    assert readers.read_weather(spark, root, "NBA", "A").count() == 0
    assert readers.read_snapshot(spark, root, "1", "MLB").first()["message"] == "none"
    assert readers.read_game_features(spark, root, "1").first()["features"] == {"a": 1.0}
    assert readers.read_odds(spark, root).first()["ml_home"] == -110.0
    assert readers.read_historical(spark, root, date(2024, 6, 30)).first()["home_final_score"] == 3
    injuries = readers.read_injuries(spark, root, "NFL", date(2024, 7, 1))
    assert injuries.columns[-1] == "injury_type" and injuries.first()["injury_type"] is None
    assert len(injuries.columns) == 7
    assert readers.stream_table(spark, root, "odds").isStreaming


def test_payload_shapes(spark, tmp_path):
    bodies = {
        "bare": '[{"id": "1"}, {"id": "2"}]', "wrapped": ' {"data": [{"id": "3"}]}',
        "object": '{"data": {"id": "4"}}', "empty": "{}", "broken": "<html>",
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    got = readers.read_payloads(spark, str(tmp_path), "id STRING")
    assert sorted(r["id"] for r in got.collect() if r["id"]) == ["1", "2", "3"]


def test_jdbc_options():
    got = readers.jdbc_options("jdbc:postgresql://db/x", "v", "id", 0, 100, 8)
    assert got["numPartitions"] == "8" and got["partitionColumn"] == "id"


def test_snapshot_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    row = "game_id string, sport string, game_date date, n int"
    make = lambda rows: spark.createDataFrame(rows, row)
    one, two = date(2024, 1, 1), date(2024, 1, 2)
    sinks.write_snapshots(make([("a", "NBA", one, 1), ("b", "NBA", two, 1)]), path)
    sinks.refresh_view(make([("c", "NBA", two, 2)]), path, sinks.SNAPSHOT_PARTITIONS)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("game_id", "n").collect()) == [("a", 1), ("c", 2)]


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "state")
    make = lambda rows: spark.createDataFrame(rows, "k string, v int, at int, p int")
    write = lambda rows: sinks.upsert(make(rows), path, ["k"], ["at"], ["p"])
    write([("a", 1, 1, 0), ("b", 1, 1, 1)])
    untouched = {f for f in spark.read.parquet(path).inputFiles() if "p=1" in f}
    write([("a", 0, 0, 0), ("c", 5, 1, 0), ("c", 6, 2, 0)])
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "at", "p").collect())
    assert got == [("a", 1, 1, 0), ("b", 1, 1, 1), ("c", 6, 2, 0)]
    assert untouched <= set(spark.read.parquet(path).inputFiles())


def test_schedule_rows_fit_the_operators(spark, tmp_path):
    """Aliases, starts and unlisted keys of a payload arrive in the columns the operators read."""
    rows = [
        {"game_id": "1", "sport": "NFL", "homeTeamName": "A", "awayTeamName": "B", "game_time_utc": "2024-07-01T17:00:00Z",
         "predictedHomeScore": 21, "predictedAwayScore": "17.5", "moneylineClean": '{"home":-120,"away":"+100"}',
         "statusState": "Scheduled", "dataType": "schedule", "referee": "R", "seats": {"n": 3}},
        {"game_id": "2", "sport": "MLB", "scheduled_time": "2024-07-01T23:05:00Z", "gameTimeUTC": "2024-07-01T23:10:00Z"},
        {"game_id": "3", "sport": "NBA", "gameTimeUTC": "soon"},
    ]
    (tmp_path / "games.json").write_text(json.dumps({"data": rows}))
    games = readers.canonical_games(readers.read_payloads(spark, str(tmp_path), TABLES["schedule"]))
    scored = reconcile.pred_scores(reconcile.derive_odds(games))
    one, two, three = scored.orderBy("game_id").collect()
    assert (one["home_team"], one["away_team"], one["status_state"], one["data_type"]) == ("A", "B", "Scheduled", "schedule")
    assert (one["pred_home"], one["pred_away"]) == (21.0, 17.5)
    assert (one["ml_home_text"], one["ml_away_text"]) == ("-120", "+100")
    assert one["extra"] == {"referee": "R", "seats": '{"n":3}'}
    assert (one["game_time_et"], one["start_ts"]) == ("1:00 PM", None)
    assert (two["game_time_et"], str(two["start_ts"])) == ("7:05 PM", "2024-07-01 23:10:00")
    assert (three["game_time_et"], three["start_ts"], three["extra"]) == ("", None, {})
    flags = games.select("game_id", slate.is_stale("2024-07-01 23:59:00").alias("s"), slate.is_final().alias("f"))
    assert [(r["s"], r["f"]) for r in flags.collect()] == [(False, False)] * 3


def test_reports_and_snapshots_fit_the_operators(spark, root):
    reports = readers.read_injury_reports(spark, root, league="NFL")
    assert reports.columns[:2] == ["league", "report_date"] and reports.count() == 1
    nested = '[{"category":"x","data":[{"category":"y","value":1}]}]'
    flat = '[{"category":"x","value":2}]'
    rows = "\n".join('{"sport":"NBA","pie_chart_data":%s}' % p for p in (nested, flat, "[]")).split("\n")
    df = spark.createDataFrame([(r,) for r in rows], "v string").select(F.from_json("v", TABLES["snapshots"]).alias("r")).select("r.*")
    flags = snapshots.section_flags(df).select("has_pie", "is_multi_pie").collect()
    assert [tuple(r) for r in flags] == [(True, True), (True, False), (False, False)]


def test_upsert_scans_touched_partitions_only(spark, tmp_path, plan_of, monkeypatch):
    path = str(tmp_path / "state")
    make = lambda rows: spark.createDataFrame(rows, "k string, at int, p int")
    sinks.upsert(make([("a", 1, 0), ("b", 1, 1), ("c", 1, None)]), path, ["k"], ["at"], ["p"])
    current, news = spark.read.parquet(path), make([("x", 1, 1), ("y", 1, None)])
    some = sinks.touched(current, news, ["p"])
    pruned = next(line for line in plan_of(some).splitlines() if "PartitionFilters" in line)
    assert "<=> 1" in pruned
    assert sorted(r["k"] for r in some.collect()) == ["b", "c"]
    assert sinks.touched(current, news.limit(0), ["p"]).count() == 0
    monkeypatch.setattr(sinks, "NAMED_PARTITIONS", 1)
    assert sorted(r["k"] for r in sinks.touched(current, news, ["p"]).collect()) == ["b", "c"]


def test_moved_rows_leave_no_copy(spark, tmp_path):
    path = str(tmp_path / "games")
    make = lambda rows: spark.createDataFrame(rows, "k string, day date, at int")
    one, two = date(2024, 1, 1), date(2024, 1, 2)
    sinks.upsert_keyed(make([("a", one, 1), ("b", one, 1)]), path, ["k"], ["at"], 4)
    for _ in range(2):
        sinks.upsert_keyed(make([("a", two, 2), ("b", two, 0)]), path, ["k"], ["at"], 4)
    got = spark.read.parquet(path).select("k", "day", "at").collect()
    assert sorted(map(tuple, got)) == [("a", two, 2), ("b", one, 1)]

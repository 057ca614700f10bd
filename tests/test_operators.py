"""Slate, injury, merge, report and snapshot rules on small hand-made rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from matchlens.functions.times import default_season_of
from matchlens.operators import injuries, joins, reconcile, reports, slate, snapshots
from matchlens.operators.reports import Sort

AS_OF = "2024-06-15 18:00:00"
NOW = datetime(2024, 6, 15, 18)
GAME = (
    "game_id int, sport string, game_date date, start_ts timestamp_ntz, status_state string, data_type string, "
    "home_final long, away_final long, pred_home double, pred_away double"
)


def games(spark, *rows):
    full = []
    for i, r in enumerate(rows):
        start = r.get("start")
        full.append(
            (i, r.get("sport", "NBA"), r.get("day", date(2024, 6, 15)), start, r.get("status"), r.get("type", "schedule"),
             r.get("hf"), r.get("af"), r.get("ph"), r.get("pa"))
        )
    return spark.createDataFrame(full, GAME)


def flags(df, column):
    return [r[1] for r in df.select("game_id", column).orderBy("game_id").collect()]


def at(hour, minute=0, day=15):
    return datetime(2024, 6, day, hour, minute)


def test_two_staleness_rules(spark):
    df = games(
        spark,
        {"start": at(14, 30)},  # over at exactly 18:00
        {"start": at(14, 31)},  # one minute left
        {"start": at(10, day=14), "day": date(2024, 6, 14)},  # yesterday
        {"start": None},
        {"start": at(17), "type": "historical", "hf": 1, "af": 0},
        {"start": at(17), "type": "historical", "hf": 1},
        {"start": at(20, day=14)},  # began yesterday, still dated today
    )
    assert flags(df, slate.is_stale(AS_OF)) == [True, False, False, False, True, False, False]
    assert flags(df, slate.is_unexpired(AS_OF)) == [False, True, True, True, True, True, False]
    # In New York it is still the same day for the last one's start.
    assert flags(df, slate.is_stale("2024-06-15 02:00:00", "America/New_York"))[-1] is True


def test_status_words(spark):
    words = ["Final", "After OT", "POSTGAME", "ended", "Scheduled", "In Progress", "Pregame", None]
    df = games(spark, *[{"status": w} for w in words])
    assert flags(df, slate.is_final()) == [True, True, True, True, False, False, False, False]
    assert flags(df, slate.needs_suffix()) == [False, True, True, True, False, True, False, False]


def test_two_precedence_orders(spark):
    df = games(
        spark,
        {"start": at(17), "status": "Final"},  # finished early, still within its window
        {"start": at(17)},
        {"start": at(20), "ph": 1.0, "pa": 2.0},
        {"start": at(21)},
        {"start": None, "day": None},
    )
    assert flags(df, slate.card_state(AS_OF)) == ["final", "in_progress", "prediction", "actions", "actions"]
    assert flags(df, slate.slate_rank(AS_OF)) == [1, 1, 0, 0, 2]
    ordered = slate.slate_order(df.filter("game_id < 4"), AS_OF).orderBy("position")
    assert [r["game_id"] for r in ordered.collect()] == [2, 3, 0, 1]
    assert slate.first_upcoming(df, AS_OF).first()["first_game_id"] == 2


def test_date_only_start_counts_from_midnight(spark):
    df = games(spark, {"start": None})
    assert flags(df, slate.is_in_progress("2024-06-15 03:29:59")) == [True]
    assert flags(df, slate.is_in_progress("2024-06-15 03:30:00")) == [False]


def test_slate_messages(spark):
    df = games(spark, {"start": at(10)}, {"start": at(20), "sport": "MLB"})
    state = slate.slate_state(slate.slate_flags(df, AS_OF)).orderBy("sport").collect()
    assert [(r["state"], r["message"]) for r in state] == [
        ("list", "MLB games for June 15"), ("concluded", "All NBA games for June 15 have concluded."),
    ]
    assert [r["all_filtered"] for r in state] == [False, True]


def test_next_date(spark):
    day = lambda d: {"day": date(2024, 6, d)}
    df = games(spark, day(1), day(8), day(16))
    after = lambda d: slate.next_date_after(df, "NBA", d).first()[0]
    assert after("2024-06-01") == date(2024, 6, 8)
    assert after("2024-06-08") is None
    assert after("2024-06-09") == date(2024, 6, 16)
    got = {r["game_date"]: r["next_date"] for r in slate.next_game_date(df).collect()}
    assert got == {date(2024, 6, 1): date(2024, 6, 8), date(2024, 6, 8): None, date(2024, 6, 16): None}


def test_game_by_id(spark):
    assert slate.game_by_id(games(spark, {}, {}), 1).count() == 1


def test_injuries(spark):
    slate_games = spark.createDataFrame(
        [("g", "NBA", date(2024, 6, 15), "New York", "Boston ")],
        "game_id string, sport string, game_date date, home_team string, away_team string",
    )
    rows = [("1", " new york "), ("2", "New York"), ("3", "boston"), ("4", "Miami"), ("5", "  "), ("6", None)]
    reports_df = spark.createDataFrame(
        [(i, t, "NBA", date(2024, 6, 15), "Out") for i, t in rows],
        "id string, team_display_name string, league string, report_date date, status string",
    )
    playing = injuries.injuries_of_playing(reports_df, slate_games)
    assert sorted(r["id"] for r in playing.collect()) == ["1", "2", "3"]
    counts = {r["team"]: r["injuries"] for r in injuries.injuries_by_team(reports_df, slate_games).collect()}
    assert counts == {"new york": 1, "New York": 1, "boston": 1}
    exact = injuries.injuries_of_games(reports_df, slate_games)
    assert [r["id"] for r in exact.collect()] == ["2"]


def test_odds_chain(spark):
    df = spark.sql("""
        SELECT 'A' AS home_team, 'B' AS away_team, CAST(NULL AS STRING) AS moneylineHome, '+5' AS moneylineAway,
               '{"home": -120, "away": 7}' AS moneyline_clean, map('A', '1', 'B', '2') AS moneyline,
               '{"home": {"line": -3.5, "odds": -110}, "away": {"american": "-105"}}' AS spread_clean,
               CAST(NULL AS DOUBLE) AS spreadLine, '{"over": 44.5}' AS total_clean
    """)
    got = reconcile.derive_odds(df).first()
    assert (got["ml_home_text"], got["ml_away_text"]) == ("-120", "+5")
    assert (got["spread_line"], got["spread_home_price"], got["spread_away_price"]) == (-3.5, "-110", "-105")
    assert got["total_line"] == 44.5
    by_team = reconcile.derive_odds(df.drop("moneyline_clean", "moneylineAway", "spread_clean", "total_clean")).first()
    assert (by_team["ml_home_text"], by_team["ml_away_text"], by_team["spread_line"]) == ("1", "2", None)


def test_summary_names(spark):
    df = spark.sql("SELECT 7 AS team_id, '2023' AS season, 1.5 AS srs_lite, 0.5 AS win_pct")
    got = reconcile.normalize_summary(df).first().asDict()
    assert got == {"teamId": 7, "season": 2023, "srsLite": 1.5, "winPct": 0.5, "srs": 1.5}
    own = reconcile.normalize_summary(df.withColumn("srs", F.lit(9.0))).first()
    assert own["srs"] == 9.0


def test_wrapper_rows(spark):
    payload = spark.sql("""
        SELECT 2023 AS season, array(named_struct('team_name', 'A', 'srs', CAST(NULL AS DOUBLE))) AS advanced,
               array(named_struct('team_name', 'a ', 'srs_rating', 2.5D)) AS srs,
               array(named_struct('team_name', 'A', 'sos', 1D), named_struct('team_name', 'A', 'sos', 3D)) AS sos""")
    advanced, srs, sos = joins.explode_wrapper(payload)
    got = joins.merge_nfl_advanced(advanced, [srs], [sos]).first()
    assert (got["srs"], got["sos"]) == (2.5, 3.0)


def test_snapshot_lookup_and_row_identity(spark):
    played = spark.sql("SELECT 'NBA' AS sport, '1' AS game_id UNION ALL SELECT 'MLB', '1'")
    found = spark.sql("SELECT 'NBA' AS sport, '1' AS game_id, 'x' AS stage")
    got = {r["sport"]: r["stage"] for r in joins.with_snapshot(played, found).collect()}
    assert got == {"NBA": "x", "MLB": None}
    ids = spark.sql("SELECT 7 AS teamId, 'A' AS team_name UNION ALL SELECT NULL, 'B'")
    assert [r[0] for r in ids.select(reconcile.row_identity(ids)).collect()] == ["7", "B"]


TEAMS = [("b", 1.0), ("a", 1.0), ("c", None), ("d", 3.0), ("e", None)]


def order(spark, kind, direction, rows=TEAMS, league="NBA", schema="team_name string, x double"):
    df = spark.createDataFrame([(*r, 1) for r in rows], schema + ", g int")
    out = reports.ranked(df, kind, Sort("x", direction), ["g"], league=league)
    return [r["team_name"] for r in out.orderBy("position").collect()]


def test_sort_rules(spark):
    assert order(spark, "teams", "asc") == ["c", "e", "a", "b", "d"]
    assert order(spark, "teams", "desc") == ["e", "c", "d", "b", "a"]
    assert order(spark, "players", "asc") == ["c", "e", "a", "b", "d"]
    assert order(spark, "players", "desc") == ["d", "a", "b", "c", "e"]
    assert order(spark, "advanced", "desc") == ["d", "a", "b", "c", "e"]
    assert order(spark, "advanced", "desc", league="NFL") == ["d", "b", "a", "e", "c"]


def test_text_order(spark):
    rows = [("1", "b"), ("2", "B"), ("3", "a")]
    by = lambda kind, **k: order(spark, kind, "asc", rows, schema="team_name string, x string", **k)
    assert by("teams") == ["3", "1", "2"]
    assert by("advanced") == ["2", "3", "1"]


def test_sort_toggle_and_router():
    assert Sort("a").toggled("a") == Sort("a", "asc")
    assert Sort("a", "asc").toggled("a") == Sort("a", "desc")
    assert Sort("a").toggled("b") == Sort("b", "asc")
    assert reports.source_name("NFL", "teams") == "nfl_summary"
    assert reports.source_name("NBA", "players") == "player_stats"
    with pytest.raises(KeyError):
        reports.headers("MLB", "players")
    assert default_season_of("NBA", date(2024, 10, 21)) == 2023
    assert default_season_of("NFL", date(2024, 10, 22)) == default_season_of("MLB", date(2024, 1, 1)) == 2024


def test_empty_report(spark):
    df = spark.createDataFrame([("x",)], "player_name string")
    say = lambda d, kind, **k: tuple(reports.empty_message(d, kind, **k).first())
    assert say(df, "players") == (False, None)
    assert say(df.filter("false"), "players") == (True, "No data.")
    assert say(df.filter("false"), "players", term="zed") == (True, "No results for “zed”")
    assert say(df.filter("false"), "teams") == (True, "No team stats for this season.")


def test_pie_rules(spark):
    rows = [
        ([("A", 1.0, None), ("B", 2.0, "red")],),
        ([(snapshots.PLACEHOLDER, 1.0, None)],),
        ([(str(i), 1.0, "") for i in range(7)],),
    ]
    df = spark.createDataFrame(rows, "p array<struct<category: string, value: double, color: string>>")
    got = [r[0] for r in df.select(snapshots.coloured(F.col("p"))).collect()]
    assert [x["color"] for x in got[0]] == ["#4ade80", "red"]
    assert got[1] is None
    assert got[2][6]["color"] == snapshots.PALETTE[0]


def test_snapshot_flags(spark):
    df = spark.sql("""
        SELECT 'NFL' AS sport, CAST(NULL AS STRING) AS message,
               array(named_struct('Home', 1D, 'Away', CAST(NULL AS DOUBLE)), named_struct('Home', 1D, 'Away', 2D)) AS bar_chart_data,
               array(1) AS key_metrics_data, array(named_struct('title', 'x', 'data', array(1))) AS pie_chart_data
        UNION ALL SELECT 'MLB', 'Exhibition', NULL, NULL, NULL""")
    a, b = snapshots.section_flags(df).collect()
    assert (a["has_pie"], a["has_key_metrics"], a["is_multi_pie"], a["is_multi_series"], a["bar_title"]) == (
        True, True, True, True, "Quarter Scoring",
    )
    assert (b["is_exhibition"], b["has_pie"], b["is_multi_series"], b["bar_title"]) == (
        True, False, False, "Scoring Averages",
    )

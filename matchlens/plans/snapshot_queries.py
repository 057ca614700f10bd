"""Snapshot arrays and chart labels."""

from pyspark.sql import functions as F

from matchlens.functions.times import default_season
from matchlens.operators import features, snapshots
from matchlens.plans import feature_queries as fq
from matchlens.plans.views import check_sql, fixed
from matchlens.sources import tables

QUERIES, CHECKS = {}, {}

PERIODS = 7
METRICS = ["for_avg", "against_avg", "differential_avg"]


def indexed(spark, sf_dir):
    """Season metrics, rounded so that equal teams tie, with their 0-100 index."""
    season = features.team_season(fq.history(spark, sf_dir))
    season = fq.rounded(season, *METRICS).select(*features.TEAM_SEASON, *METRICS)
    return snapshots.percentile_index(season, METRICS, ["sport", "season"])


def radar_index(spark, sf_dir):
    return fq.rounded(indexed(spark, sf_dir), *[f"{m}_idx" for m in METRICS])


QUERIES["radar_index"] = radar_index
_INDEXED = "SELECT sport, season, team, {raw}, {idx} FROM (SELECT sport, season, team, {rnd} FROM ts)".format(
    raw=", ".join(METRICS),
    rnd=", ".join(f"round({m}, 6) AS {m}" for m in METRICS),
    idx=", ".join(
        f"percent_rank() OVER (PARTITION BY sport, season ORDER BY {m}) * 100 AS {m}_idx" for m in METRICS
    ),
)
CHECKS["radar_index"] = check_sql(
    "SELECT sport, season, team, {}, {} FROM idx".format(
        ", ".join(METRICS), ", ".join(f"round({m}_idx, 6) AS {m}_idx" for m in METRICS)
    ),
    ts=fq._TS, idx=_INDEXED,
)


def built(spark, sf_dir):
    games = tables.games(spark, sf_dir)
    games = games.withColumn("season", default_season(F.col("sport"), F.col("game_date")))
    k = F.col("game_id")
    metrics = snapshots.side_metrics(
        games.select("game_id", "sport", "season", "home_team", "away_team"), indexed(spark, sf_dir), METRICS
    ).select("game_id", "radar_chart_data", "key_metrics_data")
    bars = snapshots.period_bars(tables.box_lines(spark, sf_dir), PERIODS)
    slices = lambda *parts: F.array(
        *[F.struct(c.alias("category"), v.alias("value"), colour.alias("color")) for c, v, colour in parts]
    )
    side = lambda s, colour: (F.concat(F.lit(f"{s.title()} "), F.col(f"{s}_team")), F.col(f"pred_{s}"), colour)
    none = F.lit(None).cast("string")
    pie = F.when(
        (F.col("sport") == "NBA") & (k % 10 == 0),
        slices((F.lit(snapshots.PLACEHOLDER), F.lit(1.0), none)),
    ).when(k % 4 != 0, slices(side("home", F.lit("#123456")), side("away", none)))
    heads = F.array(
        snapshots.headline("Total", F.col("total_line")), snapshots.headline("Start", F.hour("start_ts"))
    )
    message = F.when(k % 50 == 0, "No snapshot for exhibition games.")
    return snapshots.assemble(games, bars, metrics, heads, pie, message)


def snapshot_arrays(spark, sf_dir):
    return fq.rounded(snapshots.section_rows(built(spark, sf_dir)), "home", "away")


QUERIES["snapshot_arrays"] = snapshot_arrays
_BARS = """
SELECT game_id, period, sum(points) FILTER (is_home) AS h, sum(points) FILTER (NOT is_home) AS a
FROM box GROUP BY game_id, period"""
_SIDES = f"""
SELECT g.game_id, {", ".join(f"h.{m} AS h_{m}, a.{m} AS a_{m}, h.{m}_idx AS hi_{m}, a.{m}_idx AS ai_{m}" for m in METRICS)}
FROM (SELECT *, {fq._TURN} AS season FROM games) g
JOIN idx h ON g.sport = h.sport AND g.season = h.season AND g.home_team = h.team
JOIN idx a ON g.sport = a.sport AND g.season = a.season AND g.away_team = a.team"""
_each = lambda section, h, a: " UNION ALL ".join(
    f"SELECT game_id, '{section}' AS section, {i} AS pos, '{m}' AS label, round({h}_{m}, 6) AS home, round({a}_{m}, 6) AS away FROM sd"
    for i, m in enumerate(METRICS)
)
CHECKS["snapshot_arrays"] = check_sql(f"""
SELECT * FROM (
SELECT game_id, 'bar' AS section, CAST(row_number() OVER (PARTITION BY game_id ORDER BY period) - 1 AS INTEGER) AS pos, 'Q' || period AS label,
       CAST(h AS DOUBLE) AS home, CAST(a AS DOUBLE) AS away FROM bars WHERE game_id IN (SELECT game_id FROM games)
UNION ALL {_each('radar', 'hi', 'ai')}
UNION ALL {_each('key', 'h', 'a')}
UNION ALL SELECT game_id, 'headline', 0, 'Total ' || CAST(total_line AS VARCHAR), NULL, NULL FROM games
UNION ALL SELECT game_id, 'headline', 1, 'Start ' || hour(start_ts), NULL, NULL FROM games
UNION ALL SELECT game_id, 'pie', 0, 'Pregame Distribution N/A', 1.0, NULL FROM games WHERE sport = 'NBA' AND game_id % 10 = 0
UNION ALL SELECT game_id, 'pie', 0, 'Home ' || home_team, round(pred_home, 6), NULL FROM games WHERE NOT (sport = 'NBA' AND game_id % 10 = 0) AND game_id % 4 <> 0
UNION ALL SELECT game_id, 'pie', 1, 'Away ' || away_team, round(pred_away, 6), NULL FROM games WHERE NOT (sport = 'NBA' AND game_id % 10 = 0) AND game_id % 4 <> 0
) WHERE game_id % 50 <> 0""", ts=fq._TS, idx=_INDEXED, sd=_SIDES, bars=_BARS)  # fmt: skip


def snapshot_sections(spark, sf_dir):
    """Flags and titles of every game's snapshot, and the colours of its pie."""
    # Some feeds nest the slices one level down; here every third game does.
    slices = F.transform(
        "pie_chart_data",
        lambda x: F.struct(
            x["category"], x["value"], x["color"],
            F.when(F.col("game_id") % 3 == 0, F.array(x["value"])).alias("data"),
        ),
    )
    df = snapshots.section_flags(built(spark, sf_dir).withColumn("pie_chart_data", slices))
    shown = snapshots.coloured(F.col("pie_chart_data"))
    return df.select(
        "game_id", "is_exhibition", "has_pie", "has_key_metrics", "is_multi_pie", "is_multi_series",
        "bar_title", "pie_title", F.array_join(F.transform(shown, lambda x: x["color"]), ",").alias("pie_colors"),
    )


QUERIES["snapshot_sections"] = snapshot_sections
CHECKS["snapshot_sections"] = check_sql("""
SELECT g.game_id, ex AS is_exhibition, NOT ex AND (ph OR g.game_id % 4 <> 0) AS has_pie, NOT ex AND sd.game_id IS NOT NULL AS has_key_metrics,
       NOT ex AND (ph OR g.game_id % 4 <> 0) AND g.game_id % 3 = 0 AS is_multi_pie, NOT ex AND coalesce(multi, FALSE) AS is_multi_series,
       CASE WHEN sport = 'MLB' THEN 'Scoring Averages' ELSE 'Quarter Scoring' END AS bar_title,
       CASE WHEN sport = 'MLB' THEN 'Avg Runs Vs LHP / RHP' ELSE 'Scoring Distribution' END AS pie_title,
       CASE WHEN NOT ex AND NOT ph AND g.game_id % 4 <> 0 THEN '#123456,#60a5fa' END AS pie_colors
FROM (SELECT *, game_id % 50 = 0 AS ex, sport = 'NBA' AND game_id % 10 = 0 AS ph FROM games) g
LEFT JOIN sd ON g.game_id = sd.game_id
LEFT JOIN (SELECT game_id, bool_or(h IS NOT NULL AND a IS NOT NULL) AS multi FROM bars GROUP BY game_id) b ON g.game_id = b.game_id""",
    ts=fq._TS, idx=_INDEXED, sd=_SIDES, bars=_BARS)


def chart_labels(spark, sf_dir):
    """Tooltip and axis text of predictions and shares."""
    g = tables.games(spark, sf_dir)
    share = F.col("pred_home") / (F.col("pred_home") + F.col("pred_away"))
    name = F.concat(F.lit("Home "), F.col("home_team"))
    metric = F.when(F.col("sport") == "NBA", "OffRtg").otherwise("eFG")
    return g.select(
        "game_id",
        snapshots.bar_label(F.col("pred_home")).alias("bar"),
        snapshots.pie_label(F.col("sport"), name, F.col("pred_home")).alias("pie"),
        snapshots.radar_tooltip("Home", F.col("home_team"), F.col("pred_home")).alias("radar"),
        snapshots.offence_axis(share).alias("axis"),
        snapshots.offence_tooltip(metric, share).alias("offence"),
        snapshots.headline_value(F.col("game_id") * 1000.5).alias("headline"),
    )


QUERIES["chart_labels"] = chart_labels
_SHARE = "pred_home / (pred_home + pred_away)"
CHECKS["chart_labels"] = check_sql(f"""
SELECT game_id, {fixed('pred_home', 1)} AS bar,
       'Home ' || home_team || CASE WHEN sport = 'NBA' THEN ': ' || CASE WHEN pred_home = floor(pred_home)
          THEN CAST(CAST(pred_home AS BIGINT) AS VARCHAR) ELSE CAST(pred_home AS VARCHAR) END ELSE '' END AS pie,
       'Home • ' || home_team || ' (idx ' || {fixed('pred_home', 1)} || ')' AS radar,
       CASE WHEN {_SHARE} >= 0.5 THEN {fixed(f'{_SHARE} * 100', 0)} ELSE {fixed(_SHARE, 1)} END AS axis,
       {fixed(f'{_SHARE} * 100', 1)} || CASE WHEN sport = 'NBA' THEN '' ELSE '%' END AS offence,
       format('{{:,}}', game_id * 1000 + game_id // 2) || CASE WHEN game_id % 2 = 1 THEN '.5' ELSE '' END AS headline
FROM games""")


def period_scoring(spark, sf_dir):
    games = tables.games(spark, sf_dir).filter("sport <> 'MLB'")
    table = snapshots.period_averages(tables.box_lines(spark, sf_dir), games, [1, 2, 3, 4])
    return fq.rounded(table, "q1_avg", "q2_avg", "q3_avg", "q4_avg", "overtime_avg")


QUERIES["period_scoring"] = period_scoring
_q = ", ".join(f"round(avg(pts) FILTER (period = {p}), 6) AS q{p}_avg" for p in range(1, 5))
CHECKS["period_scoring"] = check_sql(f"""
SELECT sport, team, {_q}, round(avg(pts) FILTER (period = 5), 6) AS overtime_avg FROM (
  SELECT game_id, sport, CASE WHEN is_home THEN home_team ELSE away_team END AS team,
         least(period, 5) AS period, sum(points) AS pts
  FROM box JOIN games USING (game_id) WHERE sport <> 'MLB' GROUP BY ALL) GROUP BY sport, team""")


def runs_by_hand(spark, sf_dir):
    rows = fq.history(spark, sf_dir).filter("sport = 'MLB'")
    hand = F.when((F.col("game_id") + F.col("is_home").cast("int")) % 3 == 0, "L").otherwise("R")
    table = snapshots.runs_by_hand(rows.withColumn("opposing_hand", hand))
    return fq.rounded(table, "runs_vs_lhp", "runs_vs_rhp")


QUERIES["runs_by_hand"] = runs_by_hand
CHECKS["runs_by_hand"] = check_sql("""
SELECT season, team, round(avg(pf) FILTER (lefty), 6) AS runs_vs_lhp, round(avg(pf) FILTER (NOT lefty), 6) AS runs_vs_rhp
FROM (SELECT *, (game_id + CASE WHEN is_home THEN 1 ELSE 0 END) % 3 = 0 AS lefty FROM team_games WHERE sport = 'MLB')
GROUP BY season, team""")

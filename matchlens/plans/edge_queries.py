"""Market value of games."""

from pyspark.sql import functions as F

from matchlens.functions import odds
from matchlens.operators import edge
from matchlens.plans.views import check_sql, fixed
from matchlens.sources import tables

QUERIES, CHECKS = {}, {}


def scored(spark, sf_dir, **options):
    return edge.score_edges(tables.games(spark, sf_dir), **options)


def edge_best(spark, sf_dir):
    df = scored(spark, sf_dir, keep=["ev", "kelly"])
    r6 = lambda c: F.round(c, 6).alias(c)
    return df.select(
        "game_id", "sport", "market", "side", r6("edge_pct"), r6("model_prob"), r6("market_prob"),
        r6("z"), r6("ev"), r6("kelly"), "tier",
    )


QUERIES["edge_best"] = edge_best
CHECKS["edge_best"] = check_sql("""
SELECT g.game_id, g.sport, CASE WHEN tier IS NOT NULL THEN 'ML' END AS market, side,
       round(edge_pct, 6) AS edge_pct, round(model_prob, 6) AS model_prob, round(market_prob, 6) AS market_prob,
       round(z, 6) AS z, round(ev, 6) AS ev, round(kelly, 6) AS kelly, tier
FROM games g LEFT JOIN tiered t ON g.game_id = t.game_id""")


def edge_trace(spark, sf_dir):
    names = ["tier_base", *edge.GUARDS]
    df = edge.gated(tables.games(spark, sf_dir))
    return df.groupBy("sport", *names).agg(F.count("*").alias("games"))


QUERIES["edge_trace"] = edge_trace
CHECKS["edge_trace"] = check_sql("""
SELECT sport, greatest(t_ev, t_dz) AS tier_base, t1 AS tier_guarded, t2 AS tier_braked, t3 AS tier_boosted,
       t4 AS tier_priced, t5 AS tier_kelly,
       CASE WHEN t5 = 0 AND ev >= v1 * 0.95::DOUBLE AND e >= d1 * 0.95::DOUBLE AND zt >= z_any * 0.9::DOUBLE
                 AND delta > near * 0.6::DOUBLE THEN 1 ELSE t5 END AS tier_final,
       count(*) AS games
FROM e13 GROUP BY ALL
UNION ALL
SELECT sport, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*) FROM e7
WHERE NOT (ev > 0 AND zt >= z_any) GROUP BY sport""")


def edge_tiers_by_sport(spark, sf_dir):
    return edge.tier_summary(scored(spark, sf_dir))


QUERIES["edge_tiers_by_sport"] = edge_tiers_by_sport
CHECKS["edge_tiers_by_sport"] = check_sql("""
SELECT sport, tier, side, count(*) AS games, CAST(grouping(sport, tier, side) AS INTEGER) AS level
FROM (SELECT sport, coalesce(tier, 'none') AS tier, coalesce(side, 'none') AS side
      FROM games g LEFT JOIN tiered t ON g.game_id = t.game_id)
GROUP BY ROLLUP (sport, tier, side)""")


def edge_topk(spark, sf_dir):
    plays = edge.top_plays(scored(spark, sf_dir, keep=["ev"]), k=3)
    return plays.select("sport", "game_date", "play_rank", "game_id", "side", "tier", F.round("ev", 6).alias("ev"))


QUERIES["edge_topk"] = edge_topk
CHECKS["edge_topk"] = check_sql("""
SELECT sport, game_date, CAST(play_rank AS INTEGER) AS play_rank, game_id, side, tier, round(ev, 6) AS ev FROM (
  SELECT g.sport, g.game_date, g.game_id, t.side, t.tier, t.ev,
         row_number() OVER (PARTITION BY g.sport, g.game_date ORDER BY
           CASE tier WHEN 'HIGH' THEN 3 WHEN 'MED' THEN 2 ELSE 1 END DESC, ev DESC, g.game_id) AS play_rank
  FROM games g JOIN tiered t ON g.game_id = t.game_id) WHERE play_rank <= 3""")


def edge_badges(spark, sf_dir):
    df = scored(spark, sf_dir).filter(F.col("tier").isNotNull())
    return df.select(
        "game_id",
        odds.edge_badge(F.col("tier"), F.col("side")).alias("badge"),
        odds.edge_tooltip(*map(F.col, ["edge_pct", "model_prob", "market_prob", "z"])).alias("tooltip"),
        odds.predicted_score(F.col("pred_away"), F.col("pred_home")).alias("predicted"),
    )


QUERIES["edge_badges"] = edge_badges
CHECKS["edge_badges"] = check_sql(f"""
SELECT t.game_id, 'Edge: ' || CASE tier WHEN 'HIGH' THEN 'High' WHEN 'MED' THEN 'Medium' ELSE 'Low' END
         || ' (' || CASE side WHEN 'HOME' THEN 'Home' ELSE 'Away' END || ')' AS badge,
       'Model vs market.' || chr(10) || 'Edge: ' || CASE WHEN edge_pct >= 0 THEN '+' ELSE '' END || {fixed('edge_pct', 1)}
         || '%' || chr(10) || 'Model: ' || {fixed('model_prob * 100', 0)} || '%  |  Market: '
         || {fixed('market_prob * 100', 0)} || '%' || chr(10) || 'Z-score: ' || {fixed('z', 2)} AS tooltip,
       {fixed('pred_away', 1)} || ' – ' || {fixed('pred_home', 1)} AS predicted
FROM tiered t JOIN games g ON g.game_id = t.game_id""")


def implied_prob(spark, sf_dir):
    h, a = odds.american_to_prob(F.col("ml_home")), odds.american_to_prob(F.col("ml_away"))
    return tables.games(spark, sf_dir).select(
        "game_id",
        F.round(h, 6).alias("implied_home"),
        F.round(a, 6).alias("implied_away"),
        F.round(odds.devig(h, a), 6).alias("fair_home"),
        F.round(odds.devig(a, h), 6).alias("fair_away"),
        F.round(h + a - 1, 6).alias("vig"),
    )


QUERIES["implied_prob"] = implied_prob
CHECKS["implied_prob"] = check_sql("""
SELECT game_id, round(rh, 6) AS implied_home, round(ra, 6) AS implied_away, round(rh / (rh + ra), 6) AS fair_home,
       round(ra / (rh + ra), 6) AS fair_away, round(rh + ra - 1, 6) AS vig FROM e1""")


def kelly_ev(spark, sf_dir):
    df = edge.with_probabilities(edge.with_params(tables.games(spark, sf_dir)))
    kelly = lambda s: (F.col(f"pay_{s}") * F.col(f"model_{s}") - (1 - F.col(f"model_{s}"))) / F.col(f"pay_{s}")
    return df.select(
        "game_id", F.round("ev_home", 6).alias("ev_home"), F.round("ev_away", 6).alias("ev_away"),
        F.round(kelly("home"), 6).alias("kelly_home"), F.round(kelly("away"), 6).alias("kelly_away"),
    )


QUERIES["kelly_ev"] = kelly_ev
CHECKS["kelly_ev"] = check_sql("""
SELECT game_id, round(evh, 6) AS ev_home, round(eva, 6) AS ev_away,
       round((bh * mh - (1 - mh)) / bh, 6) AS kelly_home,
       round((ba * (1.0::DOUBLE - mh) - (1 - (1.0::DOUBLE - mh))) / ba, 6) AS kelly_away FROM e5""")


def norm_cdf(spark, sf_dir):
    x = (F.col("pred_home") - F.col("pred_away")) / 5.0
    return tables.games(spark, sf_dir).select(
        "game_id", F.round(odds.std_norm_cdf(x), 6).alias("cdf"), F.round(odds.z_for_tiering(x), 6).alias("z_tier")
    )


QUERIES["norm_cdf"] = norm_cdf
CHECKS["norm_cdf"] = check_sql("""
SELECT game_id, round(CASE WHEN y < 0 THEN 1 - (1 - w) ELSE 1 - w END, 6) AS cdf,
       round(0.75 * abs(y) + 0.25 * exp(-0.5 * y * y), 6) AS z_tier
FROM (SELECT *, 0.3989423::DOUBLE * exp(-y * y / 2) * s * (0.31938153::DOUBLE + s * ((-0.356563782)::DOUBLE
        + s * (1.781477937::DOUBLE + s * ((-1.821255978)::DOUBLE + s * 1.330274429::DOUBLE)))) AS w
      FROM (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(y)) AS s
            FROM (SELECT game_id, (pred_home - pred_away) / 5.0::DOUBLE AS y FROM games)))""")

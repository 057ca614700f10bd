"""Score prediction and its evaluation."""

from pyspark.sql import functions as F

from matchlens.operators import edge, predict
from matchlens.plans.feature_queries import FORM_GAMES
from matchlens.plans.views import check_sql
from matchlens.sources import tables

QUERIES, CHECKS = {}, {}


def time_folds(spark, sf_dir):
    return predict.fold_sizes(tables.games(spark, sf_dir).filter("home_final IS NOT NULL"))


QUERIES["time_folds"] = time_folds
CHECKS["time_folds"] = check_sql("""
SELECT CAST(fold AS INTEGER) AS fold, test_games, test_from, test_to, CAST(train_games AS BIGINT) AS train_games FROM (
  SELECT fold, count(*) AS test_games, min(g.game_date) AS test_from, max(g.game_date) AS test_to,
         sum(count(*)) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS train_games
  FROM games g JOIN (SELECT game_date, ntile(4) OVER (ORDER BY game_date) - 1 AS fold
                     FROM (SELECT DISTINCT game_date FROM games WHERE home_final IS NOT NULL)) d ON g.game_date = d.game_date
  WHERE home_final IS NOT NULL GROUP BY fold) WHERE fold > 0""")


def score_model(spark, sf_dir):
    """Ensemble trained on all slices but the last, applied to the last."""
    rows = predict.with_folds(predict.training_rows(tables.games(spark, sf_dir)))
    models = predict.fit_ensemble(rows.filter(F.col("fold") < predict.FOLDS))
    scored = predict.predict(models, rows.filter(F.col("fold") == predict.FOLDS))
    return scored.select("game_id", "sport", "label", *models, "prediction")


QUERIES["score_model"] = score_model


def model_errors(spark, sf_dir):
    return predict.evaluate(predict.training_rows(tables.games(spark, sf_dir)))


QUERIES["model_errors"] = model_errors


def ablation(spark, sf_dir):
    return predict.ablation(predict.training_rows(tables.games(spark, sf_dir)))


QUERIES["ablation"] = ablation


# Features as the operators make them, worked out again in SQL.
FORM0 = f"""
SELECT game_id, team, avg(pf) OVER w AS form_for, avg(pa) OVER w AS form_against,
       date_diff('day', lag(game_date) OVER o, game_date) AS rest_days,
       count(*) OVER (PARTITION BY sport, team ORDER BY game_date
          RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS recent_games
FROM team_games WINDOW o AS (PARTITION BY sport, team ORDER BY start_ts, game_id),
     w AS (PARTITION BY sport, team ORDER BY start_ts, game_id ROWS BETWEEN {FORM_GAMES} PRECEDING AND 1 PRECEDING)"""
MET0 = """
SELECT game_id, count(*) OVER w AS meetings,
       CASE WHEN home_team < away_team THEN 1 ELSE -1 END * avg(m) OVER w AS home_margin_avg
FROM (SELECT *, least(home_team, away_team) AS ta, greatest(home_team, away_team) AS tb,
             CASE WHEN home_team < away_team THEN home_final - away_final ELSE away_final - home_final END AS m
      FROM games WHERE home_final IS NOT NULL)
WINDOW w AS (PARTITION BY sport, ta, tb ORDER BY start_ts, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
TRAINING = """
SELECT g.game_id, fold, [g.home_final, g.away_final]::DOUBLE[] AS y,
       list_transform([h.form_for, h.form_against, a.form_for, a.form_against, h.rest_days, a.rest_days,
         h.recent_games, a.recent_games, meetings, home_margin_avg]::DOUBLE[], lambda v: coalesce(v, 0)) AS x
FROM games g JOIN form0 h ON g.game_id = h.game_id AND g.home_team = h.team
JOIN form0 a ON g.game_id = a.game_id AND g.away_team = a.team JOIN met0 m ON g.game_id = m.game_id
JOIN (SELECT game_date, ntile(4) OVER (ORDER BY game_date) - 1 AS fold
      FROM (SELECT DISTINCT game_date FROM games WHERE home_final IS NOT NULL)) d ON g.game_date = d.game_date"""
# Every fold with every choice of features, as their places.
CASES = """
SELECT * FROM (VALUES (1), (2), (3)) f(test), (VALUES ('none', [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]),
  ('form', [5, 6, 7, 8, 9, 10]), ('rest', [1, 2, 3, 4, 9, 10]), ('meetings', [1, 2, 3, 4, 5, 6, 7, 8]),
  ('all', []::INTEGER[])) c(left_out, kept)"""
PRODUCTS = """
SELECT test, i, j, sum(z[i] * z[j]) AS v
FROM (SELECT fold, list_concat([1.0::DOUBLE], x, y) AS z FROM train0) t, (SELECT DISTINCT test FROM cases0) c,
     range(1, 14) a(i), range(1, 14) b(j) WHERE fold < test GROUP BY test, i, j"""
# Centred sums of squares and products with the penalty on their diagonal, beside those with the scores.
EQUATIONS = """
SELECT test, left_out, kept, list(cells ORDER BY i) AS m FROM (
  SELECT c.test, left_out, kept, p.i, list(
           CASE WHEN p.i = p.j THEN CASE WHEN s.s2 = 0 THEN 1 ELSE s.s2 * 1.1::DOUBLE END ELSE s.s2 END ORDER BY p.j) AS cells
  FROM cases0 c JOIN products0 p ON c.test = p.test
    AND list_contains(kept, p.i - 1) AND (p.j > 11 OR list_contains(kept, p.j - 1))
  JOIN (SELECT p.test, p.i, p.j, p.v - a.v * b.v / n.v AS s2 FROM products0 p
        JOIN products0 a ON a.test = p.test AND a.i = 1 AND a.j = p.i JOIN products0 b ON b.test = p.test AND b.i = 1 AND b.j = p.j
        JOIN products0 n ON n.test = p.test AND n.i = 1 AND n.j = 1) s ON s.test = p.test AND s.i = p.i AND s.j = p.j
  GROUP BY c.test, left_out, kept, p.i) GROUP BY test, left_out, kept"""
# Gauss-Jordan elimination, one row in each turn.
SOLVED = """
SELECT * FROM (
  WITH RECURSIVE turn(test, left_out, kept, s, m) AS (
    SELECT test, left_out, kept, 0, m FROM equations0
    UNION ALL
    SELECT test, left_out, kept, s + 1, list_transform(range(1, len(m) + 1), lambda i:
        CASE WHEN i = s + 1 THEN list_transform(m[i], lambda v: v / m[s + 1][s + 1])
             ELSE list_transform(range(1, len(m) + 3), lambda j: m[i][j] - m[i][s + 1] / m[s + 1][s + 1] * m[s + 1][j]) END)
    FROM turn WHERE s < len(m))
  SELECT test, left_out, kept, m FROM turn WHERE s = len(m)
  UNION ALL SELECT test, left_out, kept, []::DOUBLE[][] FROM cases0 WHERE len(kept) = 0)"""
WEIGHTS = """
SELECT s.test, left_out, kept, l, slopes,
       (SELECT v FROM products0 p WHERE p.test = s.test AND i = 1 AND j = 11 + l) / n - coalesce(list_sum(list_transform(range(1, len(kept) + 1),
          lambda q: slopes[q] * means[kept[q]])), 0) AS first
FROM (SELECT *, list_transform(m, lambda r: r[len(kept) + l]) AS slopes FROM solved0, (VALUES (1), (2)) y(l)) s
JOIN (SELECT test, max(v) FILTER (j = 1) AS n, list(v / w ORDER BY j) FILTER (j BETWEEN 2 AND 11) AS means
      FROM (SELECT *, first_value(v) OVER (PARTITION BY test ORDER BY j) AS w FROM products0 WHERE i = 1) GROUP BY test) t
  ON s.test = t.test"""
GUESSES = """
SELECT game_id, test, left_out, l, y[l] AS y, first + coalesce(list_sum(list_transform(range(1, len(kept) + 1),
  lambda q: slopes[q] * x[kept[q]])), 0) AS guess FROM train0 t JOIN weights0 w ON t.fold = w.test"""
RMSE = """
SELECT test, left_out, l, sqrt(avg((y - guess) * (y - guess))) AS rmse FROM guesses0 GROUP BY test, left_out, l"""
VIEWS = {
    "form0": FORM0, "met0": MET0, "train0": TRAINING, "cases0": CASES, "products0": PRODUCTS,
    "equations0": EQUATIONS, "solved0": SOLVED, "weights0": WEIGHTS, "guesses0": GUESSES, "rmse0": RMSE,
}


def training(spark, sf_dir):
    return predict.training_rows(tables.games(spark, sf_dir))


def ridge_errors(spark, sf_dir):
    found = predict.ridge_errors(training(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("rmse", "mean_rmse")})


QUERIES["ridge_errors"] = ridge_errors
CHECKS["ridge_errors"] = check_sql("""
SELECT CAST(a.test AS INTEGER) AS fold, CASE a.l WHEN 1 THEN 'home_final' ELSE 'away_final' END AS score,
       round(a.rmse, 6) AS rmse, round(b.rmse, 6) AS mean_rmse
FROM rmse0 a JOIN rmse0 b ON a.test = b.test AND a.l = b.l AND a.left_out = 'none' AND b.left_out = 'all'""", **VIEWS)


def ridge_ablation(spark, sf_dir):
    found = predict.ridge_ablation(training(spark, sf_dir))
    return found.withColumn("rmse", F.round("rmse", 6))


QUERIES["ridge_ablation"] = ridge_ablation
CHECKS["ridge_ablation"] = check_sql("""
SELECT left_out, CASE l WHEN 1 THEN 'home_final' ELSE 'away_final' END AS score, round(avg(rmse), 6) AS rmse
FROM rmse0 WHERE left_out <> 'all' GROUP BY left_out, l""", **VIEWS)


def ridge_edges(spark, sf_dir):
    """Games of the last slice, scored against the market by predictions learned from the earlier ones."""
    games = tables.games(spark, sf_dir)
    predicted = games.drop("pred_home", "pred_away").join(predict.predicted_scores(training(spark, sf_dir)), "game_id")
    found = edge.score_edges(predicted)
    return found.select(
        "game_id", "sport", F.round("pred_home", 6).alias("pred_home"), F.round("pred_away", 6).alias("pred_away"),
        "side", "tier", F.round("edge_pct", 5).alias("edge_pct"),
    )


QUERIES["ridge_edges"] = ridge_edges
CHECKS["ridge_edges"] = check_sql("""
SELECT g.game_id, g.sport, round(g.pred_home, 6) AS pred_home, round(g.pred_away, 6) AS pred_away, side, tier,
       round(edge_pct, 5) AS edge_pct FROM predicted g LEFT JOIN tiered t ON g.game_id = t.game_id""",
    games="predicted", **VIEWS, predicted="""
SELECT g.* REPLACE (h.guess AS pred_home, a.guess AS pred_away) FROM games g
JOIN guesses0 h ON g.game_id = h.game_id AND h.test = 3 AND h.left_out = 'none' AND h.l = 1
JOIN guesses0 a ON g.game_id = a.game_id AND a.test = 3 AND a.left_out = 'none' AND a.l = 2""")  # fmt: skip

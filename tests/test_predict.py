"""Folds never look ahead, features never see their own game, models learn."""

import pytest
from pyspark.sql import functions as F

from matchlens.operators import predict
from matchlens.sources import tables


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return predict.training_rows(tables.games(spark, sf_dir)).cache()


def test_one_row_per_finished_game(spark, sf_dir, rows):
    games = tables.games(spark, sf_dir).filter("home_final IS NOT NULL")
    assert rows.count() == rows.select("game_id").distinct().count() == games.count()
    assert rows.filter(" OR ".join(f"{c} IS NULL" for c in predict.ALL_FEATURES)).count() == 0


def test_features_do_not_depend_on_the_game_itself(spark, sf_dir, rows):
    """Another score in the last game of all changes no feature."""
    games = tables.games(spark, sf_dir)
    last = games.filter("home_final IS NOT NULL").orderBy(F.desc("start_ts"), F.desc("game_id")).first()["game_id"]
    changed = games.withColumn(
        "home_final", F.when(F.col("game_id") == last, F.lit(999).cast("long")).otherwise(F.col("home_final"))
    )
    columns = ["game_id", *predict.ALL_FEATURES]
    again = predict.training_rows(changed)
    assert again.select(columns).exceptAll(rows.select(columns)).isEmpty()
    assert not again.select("game_id", "label").exceptAll(rows.select("game_id", "label")).isEmpty()


def test_folds_are_in_time_order(rows):
    span = predict.with_folds(rows).groupBy("fold").agg(F.min("game_date"), F.max("game_date")).orderBy("fold").collect()
    assert len(span) == predict.FOLDS + 1
    assert all(a[2] < b[1] for a, b in zip(span, span[1:]))


def test_models_learn_a_planted_signal(rows):
    planted = rows.withColumn("label", F.col("home_form_for") * 2 - F.col("away_form_for"))
    errors = {(r["fold"], r["model"]): r["rmse"] for r in predict.evaluate(planted, members=("ridge",)).collect()}
    for k in range(1, predict.FOLDS + 1):
        assert errors[k, "ridge"] == errors[k, "ensemble"] < 0.2 * errors[k, "mean"]


def test_ablation_notices_the_group_that_matters(rows):
    planted = rows.withColumn("label", F.col("home_form_for") * 2 - F.col("away_form_for"))
    error = {r["left_out"]: r["rmse"] for r in predict.ablation(planted, folds=1).collect()}
    assert set(error) == {"none", "form", "rest", "meetings"}
    assert error["form"] > 3 * max(error["none"], error["rest"], error["meetings"])


def test_ensemble_is_the_mean_of_its_members(rows):
    models = predict.fit_ensemble(rows, members=("ridge", "forest"))
    off = predict.predict(models, rows).select(
        F.max(F.abs(F.col("prediction") - (F.col("ridge") + F.col("forest")) / 2))
    )
    assert off.first()[0] < 1e-9

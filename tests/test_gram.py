"""Ridge from sums of products against fits on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.operators import gram, predict

FEATURES, LABELS = ["a", "b", "c"], ["y", "z"]


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(2)
    x = draw.normal([3, 100, 0], [1, 20, 0.1], (400, 3))
    y = np.stack([2 * x[:, 0] - 0.1 * x[:, 1] + draw.normal(0, 0.2, 400), x[:, 2] * 5 + 1], axis=1)
    return x, y


@pytest.fixture(scope="module")
def slices(spark, data):
    rows = [(i % 4, *map(float, [*a, *b])) for i, (a, b) in enumerate(zip(*data))]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, y double, z double")
    return gram.gram_sums(df.repartition(5), FEATURES, LABELS, "fold")


def direct(x, y, penalty):
    """Least squares with the penalty as extra rows."""
    mid, mean = x.mean(0), y.mean(0)
    extra = np.diag(np.sqrt(penalty * len(x)) * x.std(0))
    slopes = np.linalg.lstsq(np.vstack([x - mid, extra]), np.vstack([y - mean, np.zeros((x.shape[1], 2))]), rcond=None)[0]
    return np.vstack([mean - mid @ slopes, slopes])


@pytest.mark.parametrize("penalty", [0.0, 0.1, 5.0])
def test_weights_equal_least_squares(data, slices, penalty):
    x, y = data
    whole = slices[0] + slices[1] + slices[2] + slices[3]
    assert gram.fit(whole, penalty).weights == pytest.approx(direct(x, y, penalty), rel=1e-8, abs=1e-8)
    two = direct(x[:, [0, 2]], y, penalty)
    assert gram.fit(whole.part(["a", "c"]), penalty).weights == pytest.approx(two, rel=1e-8, abs=1e-8)


def test_errors_equal_those_of_the_rows(spark, data, slices):
    x, y = data
    fold = np.arange(400) % 4
    w = direct(x[fold < 2], y[fold < 2], 0.1)
    off = y[fold == 2] - w[0] - x[fold == 2] @ w[1:]
    found = {(k, s): (r, m) for k, s, r, m in gram.fold_errors(slices, 3, FEATURES)}
    plain = y[fold == 2] - y[fold < 2].mean(0)
    for i, label in enumerate(LABELS):
        want = np.sqrt((off[:, i] ** 2).mean()), np.sqrt((plain[:, i] ** 2).mean())
        assert found[2, label] == pytest.approx(want, rel=1e-6)
    assert len(found) == 6


def test_features_that_never_vary(spark):
    rows = [(0, float(i), 7.0, 2.0 * i + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, y double")
    model = gram.fit(gram.gram_sums(df, ["a", "b"], ["y"], "fold")[0], 0.0)
    assert model.weights[:, 0] == pytest.approx([1.0, 2.0, 0.0], abs=1e-9)
    off = df.select(F.max(F.abs(model.column("y") - F.col("y")))).first()[0]
    assert off < 1e-9


def test_folds_without_rows(spark):
    empty = spark.createDataFrame([], "fold int, a double, y double")
    assert gram.gram_sums(empty, ["a"], ["y"], "fold") == {}
    assert gram.fold_errors({}, 3, ["a"]) == []


def test_ablation_notices_the_group_that_matters(spark, sf_dir):
    from matchlens.sources import tables

    rows = predict.training_rows(tables.games(spark, sf_dir))
    planted = rows.withColumns({c: F.col("home_form_for") * 2 - F.col("away_form_for") for c in predict.SCORES})
    error = {(r["left_out"], r["score"]): r["rmse"] for r in predict.ridge_ablation(planted).collect()}
    for score in predict.SCORES:
        assert error["form", score] > 3 * max(error[g, score] for g in ("none", "rest", "meetings"))

"""Training and judging score predictors on time-ordered games.

Spark has no support vector regression, so the ensemble has three members.
"""

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.operators import gram
from matchlens.operators.features import head_to_head, team_games, team_history, with_density
from matchlens.session import written

FOLDS = 3
SEED = 42

FEATURE_GROUPS = {
    "form": ["home_form_for", "home_form_against", "away_form_for", "away_form_against"],
    "rest": ["home_rest_days", "away_rest_days", "home_recent_games", "away_recent_games"],
    "meetings": ["meetings", "home_margin_avg"],
}
SCORES = ["home_final", "away_final"]
ALL_FEATURES = [name for names in FEATURE_GROUPS.values() for name in names]


def training_rows(games: DataFrame, form_games: int = 5) -> DataFrame:
    """Finished games with what was known before their start, the home margin and both scores.

    Missing history counts as 0. Written once, because every fit reads it again.
    """
    rows = team_games(games)
    side = with_density(team_history(rows, form_games), rows).select(
        "game_id", "team", "form_for", "form_against", "rest_days", "recent_games"
    )

    def view(s):
        names = [c for c in side.columns if c not in ("game_id", "team")]
        return side.select(
            "game_id", F.col("team").alias(f"{s}_team"), *[F.col(c).alias(f"{s}_{c}") for c in names]
        )

    met = head_to_head(games).select("game_id", "meetings", "home_margin_avg")
    label = (F.col("home_final") - F.col("away_final")).cast("double").alias("label")
    played = games.filter("home_final IS NOT NULL AND away_final IS NOT NULL")
    scores = [F.col(c).cast("double").alias(c) for c in SCORES]
    base = played.select("game_id", "sport", "game_date", "home_team", "away_team", label, *scores)
    joined = base.join(view("home"), ["game_id", "home_team"]).join(view("away"), ["game_id", "away_team"])
    joined = joined.join(met, "game_id")
    features = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ALL_FEATURES]
    return written(joined.select("game_id", "sport", "game_date", "label", *SCORES, *features), "training")


MEMBERS = {
    "ridge": lambda: LinearRegression(elasticNetParam=0.0, regParam=0.1, solver="normal"),
    "forest": lambda: RandomForestRegressor(numTrees=10, maxDepth=4, seed=SEED),
    "boosted": lambda: GBTRegressor(maxIter=5, maxDepth=3, seed=SEED),
}


def fit_ensemble(
    train: DataFrame, features: list[str] = ALL_FEATURES, members: tuple = tuple(MEMBERS)
) -> dict[str, PipelineModel]:
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    return {
        name: Pipeline(stages=[assemble, MEMBERS[name]().setPredictionCol(name)]).fit(train)
        for name in members
    }


def predict(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """Each member's prediction and their mean as ``prediction``."""
    for model in models.values():
        rows = model.transform(rows).drop("features")
    mean = sum((F.col(n) for n in models), F.lit(0.0)) / len(models)
    return rows.withColumn("prediction", mean)


def day_folds(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Each playing day's slice: 0 is only trained on, ``1..folds`` are tested in turn.

    Slices hold equally many days; the window runs over distinct days.
    """
    days = rows.select("game_date").distinct()
    slice_no = F.ntile(folds + 1).over(Window.partitionBy(F.lit(0)).orderBy("game_date"))
    return days.select("game_date", (slice_no - 1).alias("fold"))


def with_folds(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    return rows.join(day_folds(rows, folds), "game_date")


def fold_sizes(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Expanding windows: what each fold trains on and tests."""
    per_slice = with_folds(rows, folds).groupBy("fold").agg(
        F.count("*").alias("test_games"), F.min("game_date").alias("test_from"), F.max("game_date").alias("test_to")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.withColumn("train_games", F.sum("test_games").over(before)).filter("fold > 0")


def evaluate(
    rows: DataFrame, features: list[str] = ALL_FEATURES, folds: int = FOLDS, members: tuple = tuple(MEMBERS)
) -> DataFrame:
    """Error per fold of every member, the ensemble and the plain mean."""
    sliced = written(with_folds(rows, folds), "folds")
    out = []
    for k in range(1, folds + 1):
        train, test = sliced.filter(F.col("fold") < k), sliced.filter(F.col("fold") == k)
        models = fit_ensemble(train, features, members)
        guess = train.agg(F.avg("label")).first()[0]
        scored = predict(models, test).withColumnRenamed("prediction", "ensemble").withColumn("mean", F.lit(guess))
        names = [*models, "ensemble", "mean"]
        rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("label") - F.col(c), 2))).alias(c)
        errors = scored.agg(*[rmse(c) for c in names]).first()
        out += [(k, name, errors[name]) for name in names]
    # One row per fold and model.
    return rows.sparkSession.createDataFrame(out, "fold int, model string, rmse double")


def ablation(
    rows: DataFrame, folds: int = FOLDS, members: tuple = ("ridge",), sample: float | None = None
) -> DataFrame:
    """Mean error over the folds with each feature group left out.

    ``sample`` is an optional seeded share of the rows for a quick look.
    """
    if sample is not None:
        rows = written(rows.sample(sample, seed=SEED), "ablation")
    reports = []
    for left_out in [None, *FEATURE_GROUPS]:
        kept = [f for g, names in FEATURE_GROUPS.items() if g != left_out for f in names]
        errors = evaluate(rows, kept, folds, members).filter("model = 'ensemble'")
        reports.append(errors.groupBy(F.lit(left_out or "none").alias("left_out")).agg(F.avg("rmse").alias("rmse")))
    return reduce(DataFrame.unionByName, reports)


def score_slices(rows: DataFrame, folds: int = FOLDS) -> dict:
    """Sums of products of features and both scores for each slice of days, in one pass."""
    return gram.gram_sums(with_folds(rows, folds), ALL_FEATURES, SCORES, "fold")


def ridge_errors(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Error of ridge on both scores by fold, beside that of the training mean; one pass over the rows."""
    found = gram.fold_errors(score_slices(rows, folds), folds, ALL_FEATURES)
    # One row per fold and score.
    return rows.sparkSession.createDataFrame(found, "fold int, score string, rmse double, mean_rmse double")


def ridge_ablation(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Mean error over the folds on each score, with each feature group left out; the same one pass."""
    slices, out = score_slices(rows, folds), []
    for left_out in [None, *FEATURE_GROUPS]:
        kept = [f for g, names in FEATURE_GROUPS.items() if g != left_out for f in names]
        found = gram.fold_errors(slices, folds, kept)
        for score in SCORES:
            of = [rmse for _, s, rmse, _ in found if s == score]
            out.append((left_out or "none", score, sum(of) / len(of) if of else None))
    return rows.sparkSession.createDataFrame(out, "left_out string, score string, rmse double")


def predicted_scores(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``game_id, pred_home, pred_away`` for the last slice, by ridge on all earlier ones."""
    sliced = written(with_folds(rows, folds), "slices")  # read for the sums and for the last slice
    slices = gram.gram_sums(sliced, ALL_FEATURES, SCORES, "fold")
    earlier = [slices[s] for s in slices if s < folds]
    last = sliced.filter(F.col("fold") == folds)
    if not earlier:
        return last.select("game_id", *[F.lit(None).cast("double").alias(c) for c in ("pred_home", "pred_away")])
    model = gram.fit(sum(earlier[1:], earlier[0]))
    home, away = (model.column(c) for c in SCORES)
    return last.select("game_id", home.alias("pred_home"), away.alias("pred_away"))

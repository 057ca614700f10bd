"""Bringing uneven rows into one shape: odds, predictions, keys, unions."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions.numbers import to_finite
from matchlens.functions.texts import parse_loose, pick, snake_to_camel
from matchlens.functions.times import clock
from matchlens.stages import observed

# Keys a prediction may arrive under, best first; X is Home/Away, x its lower case.
PREDICTION_KEYS = {
    "NBA": ("predictionX", "predX", "predicted_x_score"),
    "MLB": ("predicted_x_runs", "predictedXRuns", "predictionX"),
    "NFL": ("predicted_x_score", "predictedXScore", "predictionX"),
}


def first_of(df: DataFrame, *names: str) -> Column:
    """First non-null of the columns that exist; NULL if none does."""
    present = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None)


def tag_sport(df: DataFrame, sport: str) -> DataFrame:
    return df.withColumn("sport", F.lit(sport))


def with_game_time_et(df: DataFrame, *sources: str) -> DataFrame:
    """Eastern clock time of the first present start column; empty without one."""
    shown = clock(first_of(df, *(sources or ("scheduled_time",))))
    return df.withColumn("game_time_et", F.coalesce(shown, F.lit("")))


def derive_odds(df: DataFrame) -> DataFrame:
    """Moneylines, spread with prices and total from whichever column carries them.

    Moneyline: own column, then the JSON column, then the map keyed by team.
    The JSON columns may be encoded once or twice, or not be JSON at all.
    """
    parsed = {
        "_ml": ("moneyline_clean", "moneylineClean"),
        "_sp": ("spread_clean", "spreadClean"),
        "_tt": ("total_clean", "totalClean"),
    }
    df = df.withColumns({k: parse_loose(first_of(df, *v).cast("string")) for k, v in parsed.items()})
    df = observed(df, "odds_parsed", "_ml IS NOT NULL")
    ml, sp, tt = F.col("_ml"), F.col("_sp"), F.col("_tt")

    def moneyline(side):
        chain = [first_of(df, f"moneyline{side.title()}").cast("string"), pick(ml, f"$.{side}")]
        if "moneyline" in df.columns:
            chain.append(F.try_element_at("moneyline", F.col(f"{side}_team")))
        return F.coalesce(*chain)

    price = lambda side: pick(sp, *[f"$.{side}.{k}" for k in ("price", "odds", "american")])
    line = lambda own, *found: F.coalesce(first_of(df, own).cast("double"), *found)
    return df.withColumns(
        {
            "ml_home_text": moneyline("home"),
            "ml_away_text": moneyline("away"),
            "spread_line": line("spreadLine", pick(sp, "$.home.line", kind="double")),
            "spread_home_price": price("home"),
            "spread_away_price": price("away"),
            "total_line": line("totalLine", pick(tt, "$.line", "$.over", kind="double")),
        }
    ).drop(*parsed)


def pred_scores(df: DataFrame) -> DataFrame:
    """``pred_home`` and ``pred_away``: the first defined key of the league, if finite."""

    def value(side):
        out = F
        for sport, keys in PREDICTION_KEYS.items():
            names = [k.replace("X", side.title()).replace("_x_", f"_{side}_") for k in keys]
            out = out.when(F.col("sport") == sport, first_of(df, *names).cast("string"))
        return out

    # Chosen first and parsed after, so that the choice is made once.
    chosen = df.withColumns({"_home": value("home"), "_away": value("away")})
    return chosen.withColumns(
        {"pred_home": to_finite(F.col("_home")), "pred_away": to_finite(F.col("_away"))}
    ).drop("_home", "_away")


def normalize_summary(df: DataFrame) -> DataFrame:
    """Camel-case column names, numeric season, ``srsLite`` as ``srs`` if there is none."""
    df = df.toDF(*[snake_to_camel(c) for c in df.columns])
    if "season" in df.columns:
        df = df.withColumn("season", to_finite(F.col("season").cast("string")).cast("int"))
    if "srsLite" in df.columns and "srs" not in df.columns:
        df = df.withColumn("srs", F.col("srsLite"))
    return df


def row_identity(df: DataFrame, *names: str) -> Column:
    """``team_id`` or whichever key stands in for it."""
    names = [n for n in names or ("team_id", "teamId", "team_name") if n in df.columns]
    return F.coalesce(*[F.col(n).cast("string") for n in names])


def league_union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def feature_rows(df: DataFrame) -> DataFrame:
    """Feature maps, top level or nested, as ``(game_id, key, val)`` rows."""
    features = F.coalesce("features", "data.features")
    return df.select("game_id", F.explode(features).alias("key", "val"))

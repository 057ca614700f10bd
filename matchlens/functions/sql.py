"""The scalar functions under SQL names.

They are SQL bodies, so Catalyst inlines them; no Python runs. Each registers
as a temporary function of the session.
"""

from pyspark.sql import SparkSession

from matchlens.functions.numbers import NUMBER_PATTERN
from matchlens.functions.odds import CDF_DENSITY, CDF_SLOPE, CDF_TERMS
from matchlens.params import EDGE_PARAMS, LEAGUES


def _cdf() -> str:
    t = f"(1 / (1 + {CDF_SLOPE}D * abs(x)))"
    poly = "0D"
    for b in reversed(CDF_TERMS):
        poly = f"({poly} + {b}D) * {t}"
    return f"abs(if(x < 0, 1D, 0D) - (1 - {CDF_DENSITY}D * exp(-x * x / 2) * {poly}))"


def _sigma() -> str:
    *listed, default = EDGE_PARAMS["sigma"]
    arms = " ".join(f"WHEN '{league}' THEN {s}D" for league, s in zip(LEAGUES, listed))
    return f"CASE sport {arms} ELSE {default}D END"


DEFINITIONS = {
    "american_to_prob(o DOUBLE)": ("DOUBLE", "CASE WHEN o > 0 THEN 100 / (o + 100) WHEN o < 0 THEN -o / (-o + 100) END"),
    "payout(o DOUBLE)": ("DOUBLE", "CASE WHEN o > 0 THEN o / 100 WHEN o < 0 THEN 100 / abs(o) END"),
    "devig(mine DOUBLE, other DOUBLE)": ("DOUBLE", "CASE WHEN mine + other > 0 THEN mine / (mine + other) END"),
    "std_norm_cdf(x DOUBLE)": ("DOUBLE", _cdf()),
    "clamp(x DOUBLE, lo DOUBLE, hi DOUBLE)": ("DOUBLE", "CASE WHEN x IS NOT NULL THEN greatest(lo, least(hi, x)) END"),
    "margin_sigma(sport STRING)": ("DOUBLE", _sigma()),
    "z_for_tiering(x DOUBLE)": ("DOUBLE", "0.75D * abs(x) + 0.25D * exp(-0.5D * x * x)"),
    "expected_margin(spread DOUBLE)": ("DOUBLE", "-spread"),
    "to_finite(v STRING)": (
        "DOUBLE",
        f"CASE WHEN trim(v) = '' THEN 0D WHEN trim(v) RLIKE r'{NUMBER_PATTERN}' THEN try_cast(trim(v) AS DOUBLE) END",
    ),
    "canonical(name STRING)": ("STRING", r"lower(regexp_replace(coalesce(name, ''), r'\s+', ''))"),
}


def register(spark: SparkSession) -> None:
    for signature, (kind, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")

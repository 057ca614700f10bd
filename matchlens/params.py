"""Per-league tuning values of the value-edge job.

Fixed values: results depend on them, so they are written out plainly.
Any sport that is not listed takes the ``default`` row.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAGUES = ("MLB", "NFL", "NBA")

# Fixed values.
EDGE_PARAMS = {
    #                        MLB      NFL      NBA      default
    "sigma":                (3.8,     13.0,    12.0,    10.0),
    "dead_edge":            (0.45,    0.7,     1.0,     1.0),
    "dead_ev":              (0.0028,  0.0032,  0.0045,  0.0045),
    "z_any":                (0.22,    0.34,    0.42,    0.42),
    "z_med_high":           (0.32,    0.4,     0.48,    0.48),
    "low_delta":            (0.5,     0.6,     1.0,     1.0),
    "med_delta":            (1.1,     1.2,     2.0,     2.0),
    "high_delta":           (2.8,     3.5,     3.8,     3.8),
    "low_z":                (0.1,     0.28,    0.35,    0.35),
    "med_z":                (0.28,    0.7,     0.85,    0.8),
    "high_z":               (0.68,    1.2,     1.35,    1.2),
    "low_ev":               (0.0028,  0.0032,  0.0055,  0.005),
    "med_ev":               (0.0075,  0.008,   0.014,   0.014),
    "high_ev":              (0.017,   0.021,   0.028,   0.028),
    "tight_z1":             (0.16,    0.24,    0.25,    0.25),
    "tight_m1":             (1.03,    1.15,    1.25,    1.25),
    "tight_z2":             (0.28,    0.36,    0.4,     0.4),
    "tight_m2":             (1.01,    1.07,    1.12,    1.12),
    "guard_low":            (0.0028,  0.003,   0.0055,  0.0055),
    "guard_med":            (0.0075,  0.009,   0.014,   0.014),
    "guard_high":           (0.017,   0.02,    0.028,   0.028),
    "near_spread":          (0.35,    0.8,     1.5,     1.0),
    "swing_points":         (0.6,     3.0,     2.0,     2.0),
    "swing_ev":             (0.006,   0.007,   0.01,    0.009),
    "swing_edge":           (0.6,     0.7,     0.8,     0.7),
    "price_limit":          (-330.0,  -240.0,  -200.0,  -200.0),
    "price_edge":           (1.4,     2.0,     2.3,     2.3),
    "kelly_high":           (0.008,   0.014,   0.018,   0.018),
    "kelly_med":            (0.0035,  0.007,   0.009,   0.009),
    "kelly_low":            (None,    0.002,   0.003,   0.003),
    # Demotions that remove a tier elsewhere stop at LOW in this league.
    "keeps_low":            (True,    False,   False,   False),
}

# Gates of the expected-value tiering, the same for every league.
EV_TIER = {
    "high": (0.028, 1.3),
    "med": (0.009, 0.7),
    "low": (0.0033, 0.42),
}

# Published exponents of the points-for / points-against record.
PYTHAGOREAN_EXPONENT = {"MLB": 1.83, "NFL": 2.37, "NBA": 13.91}


def edge_params(spark: SparkSession) -> DataFrame:
    """The parameter table: always four rows, one per league and ``default``."""
    literal = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"{v}D" if type(v) is float else str(v)
    rows = [
        ", ".join([f"'{key}'", *[literal(v[i]) for v in EDGE_PARAMS.values()]])
        for i, key in enumerate(LEAGUES + ("default",))
    ]
    values = ", ".join(f"({row})" for row in rows)
    names = ", ".join(f"p_{name}" for name in EDGE_PARAMS)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(param_key, {names})")


def per_league(values: dict, default, sport="sport"):
    """A literal chosen by league."""
    out = F
    for league, value in values.items():
        out = out.when(F.col(sport) == league, F.lit(value))
    return out.otherwise(F.lit(default))

"""Observation points between the steps of long row-wise jobs."""

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_runs = itertools.count()


def observed(df: DataFrame, step: str, condition: str) -> DataFrame:
    """Count the rows that reach ``step`` and those that meet ``condition``.

    The point also ends the generated method, which keeps each one below the
    size the JVM compiles (8000 bytes; beyond it, rows run interpreted and
    several times slower), and filters set later do not move in front of it,
    where they would repeat the computation.
    """
    return df.observe(
        f"{step}_{next(_runs)}",
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.expr(condition)).alias("passing"),
    )

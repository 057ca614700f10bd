"""Reading and printing numbers the way the product's screens do."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: text that counts as a number.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

DASH = "–"


def finite(x: Column) -> Column:
    """NaN and infinities become NULL, so that later comparisons are safe.

    Spark orders NaN above infinity, so one comparison drops both.
    """
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def parse_number(text: Column) -> Column:
    """A number written as text; blank text is 0, anything else unreadable NULL."""
    t = F.trim(text)
    return F.when(t == "", F.lit(0.0)).when(
        t.rlike(NUMBER_PATTERN), finite(t.try_cast("double"))
    )


def to_finite(value: Column, text: bool = True) -> Column:
    """Finite number or NULL (blank text counts as 0)."""
    return parse_number(value) if text else finite(value.cast("double"))


def to_num(value: Column, text: bool = True) -> Column:
    """Like :func:`to_finite`, but the empty string is missing."""
    if not text:
        return finite(value.cast("double"))
    return F.when(value != "", parse_number(value))


def clamp(x: Column, lo: float, hi: float) -> Column:
    # Both functions pass over NULL, which has to stay NULL.
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def _scaled(x: Column, digits: int) -> tuple[Column, Column]:
    """``x * 10**digits`` and the rounding error of that product.

    The factor is split into falling powers of two, whose products are exact;
    the error of each addition is then recovered exactly.
    """
    first, *rest = {1: (8.0, 2.0), 2: (64.0, 32.0, 4.0)}[digits]
    total, error = x * first, None
    for part in rest:
        new = total + x * part
        lost = x * part - (new - total)
        total, error = new, lost if error is None else error + lost
    return total, error


def to_fixed(x: Column, digits: int) -> Column:
    """Fixed decimals, rounding the exact binary value with ties away from zero.

    ``1.005`` gives ``1.00`` (it is stored slightly below), ``0.25`` gives ``0.3``.
    """
    size = F.abs(x)
    if digits == 0:
        n = F.floor(size) + (size - F.floor(size) >= 0.5).cast("int")
    else:
        scaled, error = _scaled(size, digits)
        part = scaled - F.floor(scaled)
        n = F.floor(scaled) + ((part > 0.5) | ((part == 0.5) & (error >= 0))).cast("int")
        n = n.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-digits))
    return F.concat(F.when(x < 0, "-").otherwise(""), n.cast("string"))


def number_text(x: Column) -> Column:
    """Shortest text of a number: whole numbers carry no decimal point, and exponents
    stand only below a millionth and from 1e19 on."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    shortest = x.cast("string")
    plain = F.rtrim(shortest.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    plain = F.when((F.abs(x) >= 1e-6) & (F.abs(x) < 1e19), F.rtrim(plain, F.lit(".")))
    return F.when(whole, x.cast("long").cast("string")).otherwise(F.coalesce(plain, shortest))


def pct(x: Column) -> Column:
    return F.concat(to_fixed(x * 100, 0), F.lit("%"))


def edge_fmt(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), to_fixed(x, 1), F.lit("%"))


def grouped(x: Column) -> Column:
    """Thousands separators and at most three decimals, ties away from zero."""
    # Only odd sixteenths end in a tie, which the format itself would round to even.
    tie = (F.abs(x) * 16) % 2 == 1
    return F.call_function("format_number", F.when(tie, F.round(x, 3)).otherwise(x), F.lit("#,##0.###"))


# How each report column is printed.
PERCENT_KEYS = (
    "three_pct ft_pct wins_all_percentage winPct efg_pct tov_pct oreb_pct "
    "pythagoreanWinPct avgRedZonePct avgThirdDownPct pythagorean_win_pct "
    "avg_red_zone_pct avg_third_down_pct"
).split()
ONE_DECIMAL_KEYS = (
    "points_for_avg_all points_against_avg_all runs_for_avg_all runs_against_avg_all "
    "pace off_rtg def_rtg run_differential_avg home_away_run_diff_avg_split "
    "avgYardsPerDrive avgTurnoversPerGame avg_yards_per_drive avg_turnovers_per_game "
    "srs sos"
).split()
ZERO_DECIMAL_KEYS = (
    "games_played points rebounds assists minutes run_differential expected_wins "
    "luck_factor wins runs_for runs_against gp"
).split()


def format_cell(value: Column, key: str, kind: str = "number") -> Column:
    """One report cell; ``kind`` is ``number``, ``whole`` (an integer type) or ``text``."""
    if kind == "text" or (kind == "whole" and key in ZERO_DECIMAL_KEYS):
        shown = value.cast("string")
    else:
        x = F.nullif(value.cast("double"), F.lit(float("-inf")))
        if key in PERCENT_KEYS:
            shown = F.concat(to_fixed(x * 100, 1), F.lit("%"))
        else:
            shown = to_fixed(x, 0 if key in ZERO_DECIMAL_KEYS else 1)
    return F.coalesce(shown, F.lit(DASH))

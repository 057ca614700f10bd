"""Odds, probability and display expressions of the betting market."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlens.functions.numbers import (
    edge_fmt,
    finite,
    number_text,
    parse_number,
    pct,
    to_fixed,
)

# Five-term polynomial for the standard normal CDF.
CDF_SLOPE = 0.2316419
CDF_DENSITY = 0.3989423
CDF_TERMS = (0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def american(odds: Column, text: bool = True) -> Column:
    """American odds as a usable number; zero and unreadable prices are NULL."""
    x = parse_number(odds) if text else finite(odds.cast("double"))
    return F.nullif(x, F.lit(0.0))


def american_to_prob(odds: Column) -> Column:
    """Implied probability of numeric American odds (vig included)."""
    return F.when(odds > 0, F.lit(100.0) / (odds + 100)).when(
        odds < 0, -odds / (-odds + 100)
    )


def payout(odds: Column) -> Column:
    """Profit per unit staked at numeric American odds."""
    return F.when(odds > 0, odds / 100).when(odds < 0, F.lit(100.0) / F.abs(odds))


def devig(mine: Column, other: Column) -> Column:
    """Share of ``mine`` in a two-way market; NULL if either side is missing."""
    total = mine + other
    return F.when(total > 0, mine / total)


def std_norm_cdf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(x) * CDF_SLOPE)
    poly = F.lit(0.0)
    for b in reversed(CDF_TERMS):
        poly = (poly + b) * t
    upper = F.lit(1.0) - F.exp(-x * x / 2.0) * CDF_DENSITY * poly
    return F.abs(F.when(x < 0, 1.0).otherwise(0.0) - upper)


def z_for_tiering(x: Column) -> Column:
    """Confidence that discounts near pick'em games; 0.25 at its lowest."""
    return F.abs(x) * 0.75 + F.exp(x * x * -0.5) * 0.25


def expected_margin(spread_home: Column) -> Column:
    """Home margin the spread implies."""
    return -finite(spread_home.cast("double"))


def format_odd(odds: Column, text: bool = False) -> Column:
    """``+130`` / ``-150`` / ``N/A``; numeric zero is ``N/A`` but text ``"0"`` is ``0``."""
    x = parse_number(odds) if text else odds.cast("double")
    shown = F.when(x.isNull(), "NaN").otherwise(
        F.concat(F.when(x > 0, "+").otherwise(""), number_text(x))
    )
    missing = odds.isNull() if text else odds.isNull() | (x == 0)
    return F.when(missing, "N/A").otherwise(shown)


def odds_line(sport, ml_home, ml_away, spread, total, text: bool = False) -> Column:
    """``ML: h / a | spread | O/U: t``; baseball shows no spread."""
    return F.concat_ws(
        " | ",
        F.concat(
            F.lit("ML: "), format_odd(ml_home, text), F.lit(" / "), format_odd(ml_away, text)
        ),
        F.when(sport != "MLB", format_odd(spread)),
        F.concat(F.lit("O/U: "), F.coalesce(number_text(total.cast("double")), F.lit("N/A"))),
    )


def predicted_score(away: Column, home: Column) -> Column:
    return F.concat(to_fixed(away, 1), F.lit(" – "), to_fixed(home, 1))


def edge_badge(tier: Column, side: Column) -> Column:
    name = F.when(tier == "HIGH", "High").when(tier == "MED", "Medium").otherwise("Low")
    where = F.when(side == "HOME", "Home").otherwise("Away")
    label = F.concat(F.lit("Edge: "), name, F.lit(" ("), where, F.lit(")"))
    return F.when(tier.isNotNull(), label)


def edge_tooltip(edge_pct, model_prob, market_prob, z) -> Column:
    return F.concat(
        F.lit("Model vs market.\nEdge: "), edge_fmt(edge_pct),
        F.lit("\nModel: "), pct(model_prob),
        F.lit("  |  Market: "), pct(market_prob),
        F.lit("\nZ-score: "), to_fixed(z, 2),
    )

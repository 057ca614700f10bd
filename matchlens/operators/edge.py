"""Scoring games against the betting market.

Each stage adds columns; tiers are integers (0 none, 1 LOW, 2 MED, 3 HIGH)
until the last projection. Nothing here shuffles: the only join is the
broadcast of the four-row parameter table.

Between stages the row counts that explain a thin result (games priced, games
past the gate) are observed; see ``stages.observed`` for what that also does.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.numbers import clamp
from matchlens.functions.odds import (
    american,
    american_to_prob,
    devig,
    expected_margin,
    payout,
    std_norm_cdf,
    z_for_tiering,
)
from matchlens.operators.reconcile import derive_odds, pred_scores
from matchlens.operators.slate import has_market, has_prediction
from matchlens.params import EV_TIER, LEAGUES, edge_params
from matchlens.stages import observed

NONE, LOW, MED, HIGH = 0, 1, 2, 3
INFINITY = float("inf")

EDGE_COLUMNS = ["market", "side", "edge_pct", "model_prob", "market_prob", "z", "tier"]


def with_params(games: DataFrame) -> DataFrame:
    """Attach the league's parameters; other sports take the default row."""
    key = F.when(F.col("sport").isin(*LEAGUES), F.col("sport")).otherwise("default")
    params = F.broadcast(edge_params(games.sparkSession))
    return games.withColumn("param_key", key).join(params, "param_key").drop("param_key")


def with_probabilities(df: DataFrame) -> DataFrame:
    """Model and vig-free market probability of both sides, expected value, payout."""
    df = df.withColumn("margin", F.col("pred_home") - F.col("pred_away"))
    df = df.withColumn("x", F.col("margin") / F.col("p_sigma"))
    df = df.withColumns(
        {
            "model_home": clamp(std_norm_cdf(F.col("x")), 0.01, 0.99),
            "raw_home": american_to_prob(F.col("ml_home")),
            "raw_away": american_to_prob(F.col("ml_away")),
            "pay_home": payout(F.col("ml_home")),
            "pay_away": payout(F.col("ml_away")),
        }
    )
    df = df.withColumns(
        {
            "model_away": F.lit(1.0) - F.col("model_home"),
            "market_home": devig(F.col("raw_home"), F.col("raw_away")),
            "market_away": devig(F.col("raw_away"), F.col("raw_home")),
        }
    )
    # The reverse sum differs in no bit, because addition of two doubles commutes.
    out = {}
    for side in ("home", "away"):
        model = F.col(f"model_{side}")
        out[f"edge_{side}"] = (model - F.col(f"market_{side}")) * 100
        out[f"ev_{side}"] = model * F.col(f"pay_{side}") - (F.lit(1.0) - model)
    out["spread_delta"] = F.coalesce(
        F.abs(F.col("margin") - expected_margin(F.col("spread_home_line"))), F.lit(INFINITY)
    )
    return df.withColumns(out)


# HOME on a full tie: more expected value wins, then the larger edge.
HOME_BEST = "ev_home > ev_away OR (ev_home = ev_away AND abs(edge_home) >= abs(edge_away))"


def with_best_side(df: DataFrame) -> DataFrame:
    """The better side of each game and the quantities the tiers look at."""
    either = lambda name, out: f"if(home_best, {name}_home, {name}_away) AS {out}"
    df = df.selectExpr("*", f"{HOME_BEST} AS home_best").selectExpr(
        "*",
        "CASE WHEN home_best THEN 'HOME' WHEN NOT home_best THEN 'AWAY' END AS side",
        either("edge", "edge_pct"),
        either("model", "model_prob"),
        either("market", "market_prob"),
        either("ev", "ev"),
        either("pay", "pay"),
        either("ml", "price"),
        "abs(x) AS z",
    )
    df = df.withColumn("z_tier", z_for_tiering(F.col("x")))
    return df.selectExpr(
        "*",
        "abs(edge_pct) AS e",
        "(pay * model_prob - (1 - model_prob)) / pay AS kelly",
        "ev > 0 AND z_tier >= p_z_any AS open_gate",
        "abs(edge_pct) < p_dead_edge OR ev < p_dead_ev AS dead",
        "CASE WHEN z < p_tight_z1 THEN p_tight_m1 WHEN z < p_tight_z2 THEN p_tight_m2 ELSE 1D END AS tighten",
    )


def tier_from_ev() -> str:
    passes = lambda tier: "ev >= {}D AND e >= {}D".format(*EV_TIER[tier])
    return f"""CASE WHEN dead THEN {NONE}
        WHEN {passes("high")} AND z_tier >= p_z_med_high THEN {HIGH}
        WHEN {passes("med")} AND z_tier >= p_z_med_high THEN {MED}
        WHEN {passes("low")} THEN {LOW} ELSE {NONE} END"""


def tier_from_delta_z() -> str:
    """HIGH needs edge, z and value; MED and LOW two of the three."""
    votes = lambda level: (
        f"int(e >= p_{level}_delta * tighten) + int(z >= p_{level}_z * tighten)"
        f" + int(ev >= p_{level}_ev * tighten)"
    )
    return f"""CASE WHEN dead THEN {NONE}
        WHEN {votes("high")} = 3 AND z_tier >= p_z_med_high THEN {HIGH}
        WHEN {votes("med")} >= 2 AND z_tier >= p_z_med_high THEN {MED}
        WHEN {votes("low")} >= 2 THEN {LOW} ELSE {NONE} END"""


# Each guard maps the tier of the column named by ``{t}``;
GUARDS = {
    # A tier keeps sinking until the value supports it.
    "tier_guarded": """CASE
        WHEN {t} = 3 AND ev >= p_guard_high THEN 3
        WHEN {t} >= 2 AND ev >= p_guard_med THEN 2
        WHEN {t} >= 1 AND ev >= p_guard_low THEN 1 ELSE 0 END""",
    # Close to the spread a tier drops one step; very close it goes.
    "tier_braked": """CASE
        WHEN spread_delta <= p_near_spread * 0.33D THEN 0
        WHEN spread_delta > p_near_spread THEN {t}
        WHEN {t} = 3 THEN 2
        WHEN {t} >= 1 AND p_keeps_low THEN 1 ELSE 0 END""",
    # Far from the spread a tier rises one step; HIGH has to qualify, or becomes MED.
    "tier_boosted": """CASE
        WHEN {t} = 0 OR spread_delta = double('Infinity') OR spread_delta < p_swing_points
          OR ev < p_swing_ev OR e < p_swing_edge OR z_tier < p_z_any THEN {t}
        WHEN {t} = 1 THEN 2
        WHEN ev >= p_high_ev AND e >= p_high_delta * 0.95D AND z_tier >= p_z_med_high THEN 3
        ELSE 2 END""",
    # Heavy favourites with a thin edge drop one step.
    "tier_priced": """CASE
        WHEN price < p_price_limit AND e < p_price_edge
        THEN if({t} = 1 AND p_keeps_low, 1, greatest({t} - 1, 0)) ELSE {t} END""",
    # One step down where the Kelly fraction is too small; a NULL floor is not enforced.
    "tier_kelly": """CASE
        WHEN kelly < CASE {t} WHEN 3 THEN p_kelly_high WHEN 2 THEN p_kelly_med WHEN 1 THEN p_kelly_low END
        THEN {t} - 1 ELSE {t} END""",
    # Games that almost reach LOW and are clear of the spread are shown as LOW.
    "tier_final": """CASE
        WHEN {t} = 0 AND ev >= p_low_ev * 0.95D AND e >= p_low_delta * 0.95D
          AND z_tier >= p_z_any * 0.9D AND spread_delta > p_near_spread * 0.6D THEN 1
        ELSE {t} END""",
}


def with_tiers(df: DataFrame, strategy: str = "DZ") -> DataFrame:
    """Base tier and every guard in order.

    The stronger of both tierings is kept, so ``strategy`` (which one leads)
    never changes the result; it is accepted for compatibility.
    """
    if strategy not in ("EV", "DZ"):
        raise ValueError(f"strategy must be EV or DZ, not {strategy!r}")
    base = f"greatest({tier_from_ev()}, {tier_from_delta_z()})"
    df = df.selectExpr("*", f"if(open_gate, {base}, NULL) AS tier_base")
    df = observed(df, "edge_base", "tier_base > 0")
    before = "tier_base"
    for name, guard in GUARDS.items():
        # A closed gate is NULL and stays out of every later stage.
        df = df.selectExpr("*", f"if(open_gate, {guard.format(t=before)}, NULL) AS {name}")
        before = name
    return df


def gated(games: DataFrame, strategy: str = "DZ") -> DataFrame:
    """All stages: every intermediate column next to the game's own."""
    df = observed(with_params(games), "edge_input", "ml_home IS NOT NULL AND ml_away IS NOT NULL")
    df = observed(with_probabilities(df), "edge_priced", "market_home IS NOT NULL")
    df = observed(with_best_side(df), "edge_candidates", "open_gate")
    return observed(with_tiers(df, strategy), "edge_tiers", "tier_final > 0")


def score_edges(games: DataFrame, strategy: str = "DZ", keep: list[str] | None = None) -> DataFrame:
    """Adds the value edge of each game; its columns are NULL where there is none.

    Needs ``sport, pred_home, pred_away, ml_home, ml_away, spread_home_line``
    (numbers). ``keep`` names intermediate columns to retain.
    """
    shown = lambda value: f"CASE WHEN tier_final > 0 THEN {value} END"
    fields = {
        "market": "CASE WHEN tier_final > 0 THEN 'ML' END",
        "tier": "CASE tier_final WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MED' WHEN 1 THEN 'LOW' END",
    }
    fields |= {c: shown(c) for c in EDGE_COLUMNS + (keep or []) if c not in fields}
    own = [f"`{c}`" for c in games.columns]
    return gated(games, strategy).selectExpr(*own, *[f"{e} AS {c}" for c, e in fields.items()])


def score_raw(raw: DataFrame, strategy: str = "DZ") -> DataFrame:
    """Raw rows to edges: odds and predictions reconciled, then scored.

    Only unfinished games with both predictions and a market are scored; the
    others keep their row with an empty edge.
    """
    df = observed(derive_odds(raw), "odds_found", "ml_home_text IS NOT NULL")
    df = observed(pred_scores(df), "scores_found", "pred_home IS NOT NULL AND pred_away IS NOT NULL")
    gate = has_prediction() & has_market("ml_home_text", "ml_away_text", "spread_line")
    price = lambda c: F.when(F.col("_gate"), american(F.col(c)))
    df = df.withColumn("_gate", gate).withColumns(
        {"ml_home": price("ml_home_text"), "ml_away": price("ml_away_text"), "spread_home_line": F.col("spread_line")}
    )
    return score_edges(df.drop("_gate"), strategy)


def tier_summary(scored: DataFrame) -> DataFrame:
    """Games by sport, tier and side, with subtotals."""
    return (
        scored.withColumns(
            {"tier": F.coalesce("tier", F.lit("none")), "side": F.coalesce("side", F.lit("none"))}
        )
        .rollup("sport", "tier", "side")
        .agg(F.count("*").alias("games"), F.grouping_id().cast("int").alias("level"))
    )


def top_plays(scored: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best plays of each day's slate; Spark cuts to ``k`` before the shuffle."""
    rank = F.when(F.col("tier") == "HIGH", 3).when(F.col("tier") == "MED", 2).otherwise(1)
    order = Window.partitionBy("sport", "game_date").orderBy(
        rank.desc(), F.desc("ev"), F.asc("game_id")
    )
    return (
        scored.filter(F.col("tier").isNotNull())
        .withColumn("play_rank", F.row_number().over(order))
        .filter(F.col("play_rank") <= k)
    )

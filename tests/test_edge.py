"""Value edges: golden vectors, published counts and properties."""

import itertools

import pytest
from pyspark.sql import functions as F

from matchlens.operators import edge
from matchlens.sources import tables

GAME = "id int, sport string, pred_home double, pred_away double, ml_home double, ml_away double, spread_home_line double"
TIERS = {"-": None, "H": "HIGH", "M": "MED", "L": "LOW"}

# sport, predictions, prices, spread | side, edge, model, market, z, ev, kelly, tier | trace
GOLDEN = [
    ("NFL", 27, 20, -150, 130, -3, "HOME", 12.503885, 0.704871, 0.579832, 0.538462, 0.174785, 0.262177, "HHHHHHH"),
    ("NFL", 24, 21, -140, 120, -3, None, None, None, None, None, None, None, "MM-----"),
    ("NBA", 115, 108, -160, 135, -2.5, "HOME", 12.89706, 0.720166, 0.591195, 0.583333, 0.170269, 0.27243, "HHHHHHH"),
    ("MLB", 4.5, 4.4, -115, 105, None, "AWAY", 1.25199, 0.489503, 0.476983, 0.026316, 0.003481, 0.003315, "LLLLLLL"),
    ("MLB", 4.0, 5.6, -150, 135, 1.5, None, None, None, None, None, None, None, "HH-----"),
    ("NBA", 112, 111, -110, -110, None, None, None, None, None, None, None, None, None),
    ("MLB", 4.4, 2.2, -250, 235, None, "HOME", 1.342453, 0.718688, 0.705263, 0.578947, 0.006163, 0.015407, "MLLLLLL"),
    ("MLB", 4.8, 3.5, -160, 145, -1.5, "HOME", 3.263709, 0.633864, 0.601227, 0.342105, 0.030029, 0.048047, "HHMMMMM"),
    ("MLB", 6.1, 7.1, 130, -145, -1.5, "AWAY", 2.729456, 0.603785, 0.576491, 0.263158, 0.020189, 0.029274, "MMMHHHH"),
    ("NFL", 31.5, 20, -370, 355, -2, "HOME", 3.006734, 0.811818, 0.781751, 0.884615, 0.031228, 0.115544, "HHHMMMM"),
    ("NFL", 25, 33, 245, -260, -0.5, "AWAY", 1.724585, 0.73085, 0.713604, 0.615385, 0.011946, 0.031059, "MMMMLLL"),
    ("NBA", 103, 110.5, 295, -310, None, "HOME", 1.514425, 0.265985, 0.250841, 0.625, 0.050643, 0.017167, "HHHHHMM"),
    ("NFL", 24, 31.5, 260, -275, -9, "HOME", 0.727041, 0.281996, 0.274725, 0.576923, 0.015184, 0.00584, "MMMMMLL"),
    ("NBA", 107.5, 99.5, -290, 275, 9, "HOME", 1.146691, 0.747508, 0.736041, 0.666667, 0.005269, 0.015279, "L-----L"),
    ("NBA", 106, 114, 270, -285, 4.5, "AWAY", 1.49615, 0.747508, 0.732546, 0.666667, 0.009791, 0.027904, "MLLL--L"),
    ("MLB", 2.8, 6.0, 380, -395, -1.5, "AWAY", 0.716188, 0.800136, 0.792974, 0.842105, 0.002701, 0.010671, "------L"),
]


def frame(spark, rows):
    number = lambda x: None if x is None else float(x)
    return spark.createDataFrame([(i, r[0], *map(number, r[1:6])) for i, r in enumerate(rows)], GAME)


@pytest.fixture(scope="module")
def golden(spark):
    return frame(spark, GOLDEN)


def test_golden_edges(golden):
    got = {r["id"]: r for r in edge.score_edges(golden, keep=["ev", "kelly"]).collect()}
    for i, row in enumerate(GOLDEN):
        tier = TIERS[row[13][-1]] if row[13] else None
        assert got[i]["tier"] == tier, row
        assert got[i]["side"] == row[6]
        if tier:
            for name, want in zip(["edge_pct", "model_prob", "market_prob", "z", "ev", "kelly"], row[7:13]):
                assert got[i][name] == pytest.approx(want, abs=1e-6), (row, name)
        else:
            assert got[i]["market"] is None and got[i]["edge_pct"] is None


def test_golden_trace(golden):
    stages = ["tier_base", *edge.GUARDS]
    for r in edge.gated(golden).collect():
        trace = GOLDEN[r["id"]][13]
        want = [None] * 7 if trace is None else ["-LMH".index(t) for t in trace]
        assert [r[s] for s in stages] == want, GOLDEN[r["id"]]


def test_published_tier_counts(spark):
    scored = edge.score_edges(tables.games(spark, "/root/testdata/sf0.01"))
    got = {(r["sport"], r["tier"]): r["count"] for r in scored.groupBy("sport", "tier").count().collect()}
    want = {
        "MLB": {"HIGH": 3382, "MED": 1128, "LOW": 95, None: 395},
        "NFL": {"HIGH": 2757, "MED": 663, "LOW": 300, None: 1280},
        "NBA": {"HIGH": 2364, "MED": 619, "LOW": 146, None: 1871},
    }
    assert got == {(s, t): n for s, row in want.items() for t, n in row.items()}


def test_strategy_never_changes_the_result(spark, sf_dir):
    games = tables.games(spark, sf_dir)
    columns = ["game_id", "tier", "side"]
    ev = edge.score_edges(games, strategy="EV").select(columns)
    assert ev.exceptAll(edge.score_edges(games, strategy="DZ").select(columns)).isEmpty()
    with pytest.raises(ValueError):
        edge.score_edges(games, strategy="XX")


def test_missing_inputs_give_no_edge_but_keep_the_game(spark):
    base = ("NFL", 27, 20, -150, 130, -3)
    rows = [base]
    for i in (1, 2, 3, 4):
        rows.append(tuple(None if j == i else v for j, v in enumerate(base)))
    tiers = {r["id"]: r["tier"] for r in edge.score_edges(frame(spark, rows)).collect()}
    assert tiers == {0: "HIGH", 1: None, 2: None, 3: None, 4: None}


def test_unknown_sport_uses_default_parameters(spark):
    scored = edge.with_params(frame(spark, [("NHL", 1, 0, 100, 100, None)])).first()
    assert (scored["p_sigma"], scored["p_med_z"], scored["p_low_ev"]) == (10.0, 0.8, 0.005)


def test_away_home_symmetry(spark):
    """Swapping the teams swaps the side and nothing else."""
    rows = [r[:6] for r in GOLDEN]
    swapped = [(s, pa, ph, ma, mh, None if sp is None else -sp) for s, ph, pa, mh, ma, sp in rows]
    here = edge.score_edges(frame(spark, rows)).orderBy("id").collect()
    there = edge.score_edges(frame(spark, swapped)).orderBy("id").collect()
    flip = {"HOME": "AWAY", "AWAY": "HOME", None: None}
    for a, b in zip(here, there):
        assert (a["tier"], flip[a["side"]]) == (b["tier"], b["side"])


def test_probabilities_sum_to_one(spark, sf_dir):
    df = edge.with_probabilities(edge.with_params(tables.games(spark, sf_dir)))
    off = lambda s: F.max(F.abs(F.col(f"{s}_home") + F.col(f"{s}_away") - 1))
    assert max(df.agg(off("model"), off("market")).first()) < 1e-12


def test_guards_as_tables(spark):
    """Every guard on every tier and league, on both sides of its thresholds."""
    cases = edge.edge_params(spark).filter("param_key <> 'default'").withColumn(
        "t", F.explode(F.array(*map(F.lit, range(4))))
    )

    def run(guard, **columns):
        df = cases.withColumns({n: F.expr(e) for n, e in columns.items()})
        out = df.selectExpr("param_key", "t", f"{edge.GUARDS[guard].format(t='t')} AS out")
        return {(r["param_key"], r["t"]): r["out"] for r in out.collect()}

    keys = list(itertools.product(("MLB", "NFL", "NBA"), range(4)))
    same = {k: k[1] for k in keys}
    keeps = lambda league: int(league == "MLB")
    one_down = {(s, t): keeps(s) if t == 1 else max(t - 1, 0) for s, t in keys}
    assert run("tier_guarded", ev="1D") == same
    assert run("tier_guarded", ev="0D") == {k: 0 for k in keys}
    assert run("tier_guarded", ev="p_guard_med") == {(s, t): min(t, 2) for s, t in keys}
    assert run("tier_braked", spread_delta="p_near_spread * 0.3D") == {k: 0 for k in keys}
    near = {(s, t): 0 if t == 0 else 2 if t == 3 else keeps(s) for s, t in keys}
    assert run("tier_braked", spread_delta="p_near_spread") == near
    assert run("tier_braked", spread_delta="p_near_spread * 2") == same
    assert run("tier_priced", price="p_price_limit - 1", e="0.1D") == one_down
    assert run("tier_priced", price="p_price_limit", e="0.1D") == same
    assert run("tier_kelly", kelly="-1D") == one_down
    assert run("tier_kelly", kelly="1D") == same

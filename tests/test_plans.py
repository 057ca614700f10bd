"""Shape of the physical plans at scale."""

import re

import pytest

from matchlens.plans import catalog
from matchlens.sources import tables

JVM_METHOD_LIMIT = 8000
ITERATIVE = {"score_model", "model_errors", "ablation"}


@pytest.fixture(scope="module")
def plans(spark, sf_dir, plan_of):
    """Plan and generated code size of every query."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    out = {}
    for name, query in catalog.QUERIES.items():
        if name not in ITERATIVE:
            df = query(spark, sf_dir)
            sizes = re.findall(r"maxMethodCodeSize:(\d+)", plan_of(df, "codegen"))
            out[name] = (plan_of(df, "simple"), max(map(int, sizes), default=0))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return out


def test_no_python_and_no_pairwise_joins(plans):
    for name, (plan, _) in plans.items():
        for word in ("ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan, (name, word)


def test_generated_methods_are_compiled(plans):
    assert {n: size for n, (_, size) in plans.items() if size > JVM_METHOD_LIMIT} == {}


def test_flagship_does_not_shuffle(plans):
    plan = plans["edge_best"][0]
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert "LocalTableScan [param_key" in plan  # the four-row parameter table


def test_only_used_columns_are_read(plans):
    scans = [l for l in plans["unexpired"][0].splitlines() if "orders.parquet" in l]
    assert scans and all("o_totalprice" not in l and "o_orderpriority" not in l for l in scans)


def test_top_plays_are_cut_before_the_shuffle(plans):
    plan = plans["edge_topk"][0]
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_single_task_stages_hold_calendar_rows_only(plans):
    """Only folds over distinct days and one-row totals may end in one task."""
    single = {n for n, (plan, _) in plans.items() if "SinglePartition" in plan}
    assert single <= {"time_folds", "report_state"}


def test_big_joins_do_not_broadcast_by_hand(spark, sf_dir, plan_of):
    """Without Spark's own size limit every table join of the game view is a shuffle join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(tables.games(spark, sf_dir), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_injury_texts_are_made_before_the_join(spark, sf_dir):
    """A report meets many games; its texts are made once."""
    plan = catalog.QUERIES["injuries_by_game"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Join")
    assert "concat" not in above and "date_format" not in above
    assert "concat" in below and "date_format" in below

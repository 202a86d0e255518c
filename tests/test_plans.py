"""What the physical plans must and must not hold."""

from pathlib import Path

import pytest

from ticketmill.checks.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def eager(name):
    """Queries that write or stream when they are built."""
    return name.startswith(("read_", "stream_", "ingested_", "stored_", "tag_", "ingest_"))


@pytest.mark.parametrize("name", [n for n in QUERIES if not eager(n)])
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["top_categories", "top_agents", "slow_cases", "export_documents", "resolution_by_agent_top"])
def test_limits_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SF_DIR))


def test_ranges_reach_the_scan(spark, tmp_path):
    from ticketmill.checks import fixtures as fx
    from ticketmill.plans import resolution

    fx.TICKETS.frame(spark, SF_DIR).write.parquet(str(tmp_path / "t"))
    plan = plan_of(resolution.resolution_by_source(spark.read.parquet(str(tmp_path / "t")), "2024-01-05", "2024-01-25"))
    assert "GreaterThanOrEqual(closed_at,2024-01-05T00:00)" in plan and "LessThan(closed_at,2024-01-26T00:00)" in plan
    assert "IsNotNull(created_at)" in plan
    assert "ReadSchema: struct<created_at:timestamp_ntz,closed_at:timestamp_ntz,source:string>" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_first_rows_are_picked_before_the_shuffle(spark):
    plan = plan_of(QUERIES["insert_if_absent"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan and "Partial" in plan

import pytest
from compare import compared

from lumenfold.plans import catalog

EVENT = "event_id long, user_id long, event_type string"


@pytest.mark.parametrize("name", ["chain_follow_up", "chain_meeting", "chain_strategy", "agent_strategy"])
def test_no_requests_are_broadcast(spark, tmp_path, name):
    """Written requests compress too well for their size to tell how many they are."""
    rows = [(k, k % 40, ("click", "view", "error")[k % 3]) for k in range(400)]
    spark.createDataFrame(rows, EVENT).write.parquet(f"{tmp_path}/events.parquet")
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "request_id" in line]
    assert joins and all("strategy=merge" in line for line in joins)
    compared(spark, tmp_path, name)

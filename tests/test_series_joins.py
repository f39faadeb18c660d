import pytest
from conftest import SF

from phasorlake.plans import registry


@pytest.mark.parametrize("name", ["p24_event_windows", "p25_task_vector"])
def test_series_are_never_broadcast(spark, name):
    """The sizes of exploded rows are unknown to the plan, which took them for small."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

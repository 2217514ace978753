"""Plans of the training-data queries: no all-pairs join; the native ones without Python."""

import pytest

from lanewise.llm.queries import QUERIES

NATIVE = {"op4_secret_scan", "op7_mixing"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in NATIVE:
        assert not any(word in plan for word in ("InPandas", "InArrow", "PythonUDF", "EvalPython"))

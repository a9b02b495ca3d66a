"""Plan properties the design relies on."""
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

QUERIES = entry.queries()
STREAMS = {"stream_refresh_revenue", "stream_status_events", "stream_ingest_summaries"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_uses_partial_group_limit(spark):
    p = _plan(QUERIES["vector_topk"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_join(spark, name):
    p = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p

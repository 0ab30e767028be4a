"""All registered queries, in the order of the inventory."""

from turnstone.plans import (  # noqa: F401
    contract_queries, eval_queries, event_queries, record_queries, review_queries, source_queries, stream_queries, task_queries, usage_queries,
)
from turnstone.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "r01_usage_alerts_by_user"

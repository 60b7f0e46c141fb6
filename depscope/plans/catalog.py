"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from depscope.plans import graph_queries, level_queries, metric_queries, source_queries  # noqa: F401  they register
from depscope.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

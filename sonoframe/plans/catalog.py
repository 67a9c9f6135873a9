"""All registered queries, by topic module."""

from sonoframe.plans import (  # noqa: F401  (importing a module registers its queries)
    query_audit, query_events, query_metrics, query_models, query_series, query_sources, query_tables,
)
from sonoframe.plans.registry import ORACLES, QUERIES  # noqa: F401

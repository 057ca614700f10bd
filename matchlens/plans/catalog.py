"""All named queries."""

from matchlens.plans import (
    edge_queries,
    feature_queries,
    feed_queries,
    injury_queries,
    model_queries,
    report_queries,
    slate_queries,
    snapshot_queries,
    stream_queries,
)

_MODULES = (
    edge_queries,
    slate_queries,
    injury_queries,
    feature_queries,
    report_queries,
    snapshot_queries,
    stream_queries,
    model_queries,
    feed_queries,
)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
CHECKS = {name: sql for m in _MODULES for name, sql in m.CHECKS.items()}

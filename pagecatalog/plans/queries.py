"""All registered queries."""

from pagecatalog.plans import (  # noqa: F401
    enrich_queries, extract_queries, job_queries, link_queries, progress_queries, sink_queries,
    stream_queries)
from pagecatalog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

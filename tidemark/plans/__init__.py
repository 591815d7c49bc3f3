"""Named queries (Spark builders + DuckDB oracle SQL).

Importing this package registers every query module.
"""

from tidemark.plans import (feature_queries, prep_queries, profile_queries, strategy_queries,  # noqa: F401
                            model_queries, report_queries, serving_queries, stream_queries,
                            window_queries)
from tidemark.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]

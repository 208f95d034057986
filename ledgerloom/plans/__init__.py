"""All registered queries of the library."""

from . import check_queries, codec_queries, inspect_queries, kv_queries, log_queries, stream_queries
from .registry import QUERIES, SQL, Query

__all__ = ["check_queries", "codec_queries", "inspect_queries", "kv_queries", "log_queries", "oracle_sql", "queries", "stream_queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

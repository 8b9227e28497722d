"""All named queries."""

from . import gen_queries, kv_queries, more_queries, ts_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

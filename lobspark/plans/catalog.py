"""Imports every query module so that the registry is complete."""

from lobspark.plans import queries_bars, queries_book, queries_eval, queries_files, queries_l3, queries_parity, queries_replay, queries_sources, queries_stitch, queries_stream, queries_trades, queries_updates  # noqa: F401
from lobspark.plans.registry import all_queries as queries  # noqa: F401
from lobspark.plans.registry import all_sql as sql  # noqa: F401

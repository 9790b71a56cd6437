"""All registered queries and their SQL, by name."""

from shiftwright.plans import (
    queries_checks, queries_order, queries_report, queries_retrieve, queries_rewrite, queries_scan, queries_stream,
)

_MODULES = [
    queries_scan, queries_rewrite, queries_checks, queries_order, queries_report, queries_retrieve, queries_stream,
]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

"""Registered queries: each applies an operator to the driver's tables, beside the SQL that gives the same rows."""

from factloom.plans import catalogs, comparisons, contexts, details, flows, graphs, patches, queues, scalars, searches, shapes, summaries  # noqa: F401
from factloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

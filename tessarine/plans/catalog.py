"""All registered queries of the library and their SQL."""

from __future__ import annotations

from tessarine.plans import derived, index_plans, interval_plans, search_plans, store_plans, text_plans  # noqa: F401

QUERIES = derived.QUERIES
ORACLE_SQL = derived.ORACLE_SQL

"""Core queries by name, and their SQL."""

from __future__ import annotations

from evidencia.plans import core_queries, problems

QUERIES: dict = core_queries.QUERIES | {
    "p2_found": problems.p2_found,
    "p2_not_unique": problems.p2_not_unique,
    "p2_benchmark": problems.p2_benchmark,
    "p7_found": problems.p7_found,
    "p7_searches": problems.p7_searches,
    "p7_listings": problems.p7_listings,
    "p7_extensions": problems.p7_extensions,
    "p7_places": problems.p7_places,
}
SQL: dict = core_queries.SQL | problems.SQL

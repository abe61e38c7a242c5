"""All queries of the catalogue engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import audit_queries, catalog_queries, family_queries, figure_queries, measure_queries, reader_queries, record_queries, reference_queries, screening_queries, text_queries, upkeep_queries

FLAGSHIP = "pareto_best_point"
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
for _module in (catalog_queries, measure_queries, text_queries, upkeep_queries, reader_queries, audit_queries, record_queries, figure_queries, family_queries, screening_queries, reference_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

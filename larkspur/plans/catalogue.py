"""Every query by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from larkspur.plans import catalog_queries, file_queries, interval_queries, linear_queries, relational_queries, scoring, sequence_queries, summaries

FLAGSHIP = "flagship_concept_scores"

MODULES = (scoring, interval_queries, sequence_queries, relational_queries, linear_queries, catalog_queries, file_queries, summaries)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: text for module in MODULES for name, text in module.ORACLE_SQL.items()}

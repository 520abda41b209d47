"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from larkspur.llm import collocations, fingerprints, hard_negatives, language, licenses, mixing, neighbours, packaged_warc, packing, pii, simhash, token_counts, url_filters

MODULES = (language, mixing, neighbours, token_counts, packing, licenses, fingerprints, url_filters, simhash, pii, hard_negatives, packaged_warc, collocations)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: text for module in MODULES for name, text in module.ORACLE_SQL.items()}

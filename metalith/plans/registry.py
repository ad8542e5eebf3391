"""All queries of the library and their DuckDB SQL, by name."""

from __future__ import annotations

from . import analysis_queries, family_queries, graph_queries, record_queries, residue_queries, site_queries

QUERIES = site_queries.QUERIES | analysis_queries.QUERIES | graph_queries.QUERIES | record_queries.QUERIES | residue_queries.QUERIES | family_queries.QUERIES
ORACLES = site_queries.ORACLES | analysis_queries.ORACLES | graph_queries.ORACLES | record_queries.ORACLES | residue_queries.ORACLES | family_queries.ORACLES

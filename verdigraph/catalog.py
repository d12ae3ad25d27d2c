"""All queries of the core library with their SQL."""

from __future__ import annotations

from verdigraph.plans import answer_queries, cypher_queries, document_queries, graph_queries, pattern_queries, pipeline_queries, report_queries, review_queries

QUERIES = {**answer_queries.QUERIES, **graph_queries.QUERIES, **cypher_queries.QUERIES, **document_queries.QUERIES, **pattern_queries.QUERIES, **pipeline_queries.QUERIES, **review_queries.QUERIES, **report_queries.QUERIES}
ORACLE_SQL = {**answer_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL, **cypher_queries.ORACLE_SQL, **document_queries.ORACLE_SQL, **pattern_queries.ORACLE_SQL, **pipeline_queries.ORACLE_SQL, **review_queries.ORACLE_SQL, **report_queries.ORACLE_SQL}

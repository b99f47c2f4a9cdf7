"""The registered queries over the driver's tables, and SQL where SQL can say the same."""

from __future__ import annotations

from tessera.plans import corpus_queries, hybrid_queries, report_queries, retrieval_queries, stream_queries, text_queries, topic_queries, vector_queries

FLAGSHIP = "bm25_search"
_PARTS = [report_queries, retrieval_queries, hybrid_queries, vector_queries, text_queries, corpus_queries, topic_queries, stream_queries]
QUERIES = {k: f for part in _PARTS for k, f in part.reg.queries.items()}
ORACLE_SQL = {k: s for part in _PARTS for k, s in part.reg.sql.items()}

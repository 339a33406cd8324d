"""All registered queries of the engine itself."""

from __future__ import annotations

from quillspark.plans import io_queries, ranker_queries, retrieval_queries, set_queries, text_queries

_PARTS = (text_queries, retrieval_queries, set_queries, ranker_queries, io_queries)
QUERIES = {n: f for p in _PARTS for n, f in p.QUERIES.items()}
ORACLES = {n: s for p in _PARTS for n, s in p.ORACLES.items()}

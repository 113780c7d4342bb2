"""All core queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from skein.plans import evaluation_queries, exchange_queries, hierarchy_queries, report_queries, retrieval_queries, sampling_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (exchange_queries, sampling_queries, retrieval_queries, evaluation_queries, hierarchy_queries, report_queries):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)

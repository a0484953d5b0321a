"""All queries of the library and the SQL of those that SQL can express."""

from palimpsest.plans import branch_queries, changes, claim_queries, corpus, node_queries, span_queries

QUERIES = {**corpus.QUERIES, **changes.QUERIES, **node_queries.QUERIES, **claim_queries.QUERIES, **span_queries.QUERIES, **branch_queries.QUERIES}
ORACLE = {**corpus.ORACLE, **changes.ORACLE, **node_queries.ORACLE, **claim_queries.ORACLE, **span_queries.ORACLE, **branch_queries.ORACLE}

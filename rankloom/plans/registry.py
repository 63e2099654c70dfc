"""All named queries of the library and the SQL of those that SQL can express."""

from __future__ import annotations

from rankloom.plans import evaluation, flows, networks, retrieval, walks

QUERIES = {**retrieval.QUERIES, **networks.QUERIES, **evaluation.QUERIES, **walks.QUERIES, **flows.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **networks.ORACLE_SQL, **evaluation.ORACLE_SQL, **walks.ORACLE_SQL, **flows.ORACLE_SQL}

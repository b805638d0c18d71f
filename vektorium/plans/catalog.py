"""All named queries of the core and the SQL they are compared with."""

from __future__ import annotations

from vektorium.plans import change_queries, core_queries

FLAGSHIP = "knn_l2"

QUERIES = {**core_queries.QUERIES, **change_queries.QUERIES}
SQL = {**core_queries.SQL, **change_queries.SQL}

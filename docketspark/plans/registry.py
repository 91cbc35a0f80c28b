"""All registered queries on the driver's tables and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The request log of sources.requests.request_log, for SQL.
LOG = """req AS (
    SELECT l_orderkey AS request_id, l_linenumber AS line, l_partkey AS part, CAST(l_shipdate AS DATE) AS reg, o_custkey AS requester,
           l_suppkey AS agency, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_linestatus AS status, o_orderpriority AS channel,
           CAST(o_orderdate AS DATE) AS asked, l_quantity AS quantity, year(l_shipdate) AS year, l_orderkey % 5 AS fold
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, and its SQL; `{LOG}` stands for the request log."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{LOG}", LOG)
        return f

    return add


from docketspark.plans import audits, evaluation, experiments, features, serving  # noqa: E402, F401

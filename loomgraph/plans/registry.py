"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources import projection as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTE = f"WITH RECURSIVE nodes AS ({P.plain(P.NODES)}), edges AS ({P.plain(P.EDGES)})"


SYMBOLS_CTE = f"WITH RECURSIVE symbols AS ({P.plain(P.SYMBOLS)})"


def query(sql: str | None = None, with_graph: bool = True):
    """Register a function of (spark, folder) under its name, with its SQL after the graph's CTEs."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"{_CTE}{sql}" if sql.startswith(",") else f"{_CTE} {sql}") if with_graph else sql
        return f

    return add

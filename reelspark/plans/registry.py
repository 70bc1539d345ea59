"""All registered queries of the media operators, with SQL of its own for each.

A case names its columns and types once; both sides are cast to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Inputs, duck

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_DUCK = {"long": "bigint", "double": "double", "string": "varchar", "boolean": "boolean"}


def case(name: str, columns: str, build: Callable[[Inputs], DataFrame], sql: str) -> None:
    """Register a query: its columns ('a long, b string'), the operator on its inputs, and DuckDB SQL for the same rows."""
    typed = [c.split() for c in columns.split(", ")]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Inputs(spark, sf_dir)).select([F.col(c).cast(t).alias(c) for c, t in typed])

    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    ORACLE_SQL[name] = duck(f"select {', '.join(f'cast({c} as {_DUCK[t]}) as {c}' for c, t in typed)} from ({sql}) q")

"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _tidy(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    A round points every node at the first of its neighbours and itself, and
    replaces edges by those between the targets, until none is left. The order is
    by id in the first rounds, which ends stars around small ids at once, then a
    random one, new in each round, in which chains lose a part of their nodes. Firsts are combined before the shuffle, joins
    are equi-joins that AQE can split at hot nodes, and each round's tables are
    checkpointed. Edges with a null end or from a node to itself are no edges;
    no edges give an empty table.
    """
    rest, steps = cut(_tidy(edges, a, b)), []
    while not rest.isEmpty():
        order = (lambda node: F.col(node)) if len(steps) < 2 else (lambda node: F.xxhash64(node, F.lit(len(steps))))
        both = rest.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(rest.select(F.col("v"), F.col("u")))
        first = both.groupBy("node").agg(F.min_by("other", order("other")).alias("other"))
        step = cut(first.select("node", F.when(order("node") <= order("other"), F.col("node")).otherwise(F.col("other")).alias("parent")))
        steps.append(step)
        moved = rest.join(step.select(F.col("node").alias("u"), F.col("parent").alias("pu")), "u").join(step.select(F.col("node").alias("v"), F.col("parent").alias("pv")), "v")
        rest = cut(_tidy(moved, "pu", "pv"))
    if not steps:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = steps[-1].withColumnRenamed("parent", "root")
    for step in reversed(steps[:-1]):
        up = out.select(F.col("node").alias("parent"), "root")
        out = step.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    out = cut(out)
    smallest = out.groupBy("root").agg(F.min("node").alias("component"))
    return cut(out.join(smallest, "root").select("node", "component"))

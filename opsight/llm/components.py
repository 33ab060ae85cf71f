"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import discard, written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b).

    Every round links the larger neighbours of a node to the smallest one, then the smaller
    neighbours; both steps keep the components and halve the distances. A round's edges are
    written to the shared folder. A hub with many edges only ever takes part in aggregates
    and joins on the edge table.
    """
    current = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges"
    )
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(large.filter("a != b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
        following = written(small.filter("a != b").distinct(), "edges")
        same = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first() for x in (current, following)]
        discard(large, current)
        current = following
        if same[0] == same[1]:
            break
    roots = current.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.join(current.select(F.col("a").alias("node")), "node", "left_anti")
    )

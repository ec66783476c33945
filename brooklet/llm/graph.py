"""Connected components of links between classes, without a driver-side graph.

Large-star and small-star rounds (Kiveris et al., 2014) shrink the edges to stars.
Each half round takes minima per node (partial aggregates first) and joins them back;
the minima are written, so that the join's hot side can be split. A node is any
orderable value; its component is named by its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import written


class LocalForest:
    """Union-find over the rows of one task, by numbers; keeps the smallest as root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def union(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) in any direction -> (node, root) for every node but the roots."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large")
        least = written(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
        joined = large.join(least, F.col("a") == F.col("n"))
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
        if (after := _state(now)) == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def class_table(classes: DataFrame, counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per class (key, first_id, n): key, first_id, n_links of each member, component_id.

    Members of a class are copies and link to each other; counts (key, linked) holds
    the members of other classes that a class links to.
    """
    found = components(edges)
    linked = counts.groupBy("key").agg(F.sum("linked").alias("linked"))
    # every class of a component with its root; roots name themselves
    placed = written(found.union(found.select("root", "root").distinct()).join(classes.select(F.col("key").alias("node"), "first_id"), "node"), "placed")
    least = written(placed.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id")), "roots")
    named = placed.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("key"), "component_id")
    return (
        classes.select("key", "first_id", "n").join(linked, "key", "left").join(named.withColumn("in_group", F.lit(True)), "key", "left")
        .select("key", "first_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("in_group"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    )

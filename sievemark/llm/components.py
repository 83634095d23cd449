"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its least node.

    Every round ties each node's larger neighbours to its least one, then each node's smaller neighbours to
    their least one, until nothing changes: a logarithmic number of rounds, each one join of the links and a
    pre-aggregated minimum. Labels of a former call can stand for the links that it was given. A null or a loop is no
    link; without links the result is empty.
    """
    edges = common.written(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, old = state, edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.written(large.filter("u != v"), "edges")  # no more rows than edges; those that are equal meet below
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = common.written(small.filter("u != v").distinct(), "edges")
        common.dropped(links.sparkSession, old, large)
    ends = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    label = common.written(ends.union(roots.join(edges.select(F.col("u").alias("node")), "node", "left_anti")), "labels")
    common.dropped(links.sparkSession, edges)
    return label

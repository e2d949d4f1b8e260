"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.store import written


def connected(links: DataFrame) -> DataFrame:
    """(cid, comp) for every node of `links` (a, b): comp is the least node that links reach.

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller
    ones, are tied to the least node of its neighbourhood. Each round at least squares the reach, and no
    step gathers a neighbourhood in one place: the least neighbour is an aggregate that is joined back.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "components")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "components")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = written(small.select("e.u", "e.v").filter("u != v").distinct(), "components")
        same = small.count() == edges.count() and small.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = small
        if same:
            break
    nodes = edges.select(F.col("u").alias("cid"), F.col("v").alias("comp"))
    roots = edges.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct()
    return written(nodes.union(roots), "components")

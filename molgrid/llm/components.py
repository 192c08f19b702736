"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molgrid.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large) or the smaller (small) neighbours of each node on its smallest one."""
    ways = edges.select("u", "v")
    if large:
        ways = ways.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    joined = ways.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root: root is the smallest node of its component. `edges` has the long columns a and b.

    Only nodes of an edge between two different nodes appear. Each round is one large and one small star, written to
    the shared folder; the number of rounds grows with the logarithm of the longest path. Rounds end when the edges,
    which then all hang on roots, stop changing.
    """
    now = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        now = materialize(_star(_star(now, large=True), large=False), name)
    tails = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tails.unionByName(tails.select(F.col("root").alias("node"), "root").distinct())

"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two shuffles and is written to the shared folder; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.io import discard, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join every node's larger (or its smaller) neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
    joined = both.join(least, F.col("a") == F.col("n"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node that it reaches.

    Edges are kept with a > b; a fixed point of the rounds is a star around each least node."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = settle(e, "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        last, e = e, settle(_star(_star(e, True), False), "edges")
        discard(last)
    least = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return least.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

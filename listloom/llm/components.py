"""Connected components of an edge table, by alternating stars.

In a large-star step every node hands its smallest neighbour (itself included) to
its larger neighbours; in a small-star step, to its smaller ones.  Steps alternate
until nothing changes, which takes a number of rounds that grows with the logarithm
of the size.  Minima are pre-aggregated before the shuffle, and joins on a hot node
are split by adaptive execution.  Each round is written to the shared folder, so
lineage stays short and lost executors cost little.  Self-loops and nulls are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.llm.tables import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = around.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its smallest node."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    now = stored(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, large = mark(now), True
    unchanged = 0
    while unchanged < 2 and before[0]:
        now = stored(_star(now, large), "edges")
        after = mark(now)
        unchanged = unchanged + 1 if after == before else 0
        before, large = after, not large
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", "b"))

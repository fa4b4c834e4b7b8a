"""Reachability over links, as a delta iteration.

What was reached is a table of parts by code, written once.  A round reads only the
links of its frontier's parts, looks candidates up only in the parts they fall into, and
adds only rows that are new, so a round costs what it touches, not what was found so far.

Long chains would still take a round a link.  A code with one link in and one out can
be reached in one way only, so chains of such codes are contracted beforehand: pointer
jumping gives each its head and distance in as many rounds as the logarithm of the
longest chain, and the rounds of the iteration see one weighted link for it.

Tables of rounds lie in the shared folder: a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.operators.joins import small_side
from listloom.session import work_dir

#: Parts of the tables of links and of reached codes.
PARTS = 64
#: Tasks that write the links of one part, so that a code with very many links is split.
SPLITS = 8


def _part(code: str) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(PARTS)).cast("int")


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Parted:
    """A growing table in parts by code; reading takes only the parts asked for."""

    def __init__(self, spark: SparkSession, label: str, schema: str):
        self._spark, self._path, self._schema = spark, work_dir(spark, label), f"{schema}, part int"
        self._known: set[int] = set()

    def append(self, df: DataFrame, code: str, splits: int = 1) -> None:
        rows = df.withColumn("part", _part(code))
        salt = F.pmod(F.hash(*df.columns), F.lit(splits))
        # Written even without rows, so that it can be read.
        rows.repartition("part", salt).write.mode("append").partitionBy("part").parquet(self._path)

    def of(self, rows: DataFrame, code: str) -> DataFrame:
        """The rows in the parts that codes of ``rows`` fall into."""
        parts = sorted(r["part"] for r in rows.select(_part(code).alias("part")).distinct().collect())
        return self.all().where(F.col("part").isin(parts)).drop("part")

    def all(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._path)


def chains(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(code, head, steps) of codes that are reached over one link only and lead to one only.

    ``head`` is the last code before the chain; codes on a circle nothing leads into
    have none and are left out, as they are never reached.
    """
    into = links.groupBy("linked").agg(F.count("*").alias("n"), F.min("code").alias("head")).where("n = 1")
    out = links.groupBy("code").agg(F.count("*").alias("n")).where("n = 1").select("code")
    inner = into.select(F.col("linked").alias("code"), "head").join(out, "code").join(seeds, "code", "left_anti")
    inner = _stored(inner.withColumn("steps", F.lit(1)), "chains")
    heads = inner.select(F.col("code").alias("head"), F.lit(True).alias("inside")).distinct()
    now = _stored(inner.join(heads, "head", "left").select("code", "head", "steps", "inside"), "chains")
    left = now.where("inside").count()
    while left:
        onward = now.select(
            F.col("code").alias("head"), F.col("head").alias("to"), F.col("steps").alias("more"), F.col("inside").alias("still")
        )
        joined = now.where("inside").join(onward, "head").selectExpr("code", "to AS head", "steps + more AS steps", "still AS inside")
        now = _stored(now.where("inside IS NULL").unionByName(joined), "chains")
        before, left = left, now.where("inside").count()
        if left == before:
            break
    return now.where("inside IS NULL").drop("inside")


def contracted(links: DataFrame, inner: DataFrame) -> DataFrame:
    """Links (code, linked, steps) between codes outside of chains, chains as one link."""
    codes = inner.select(F.col("code").alias("linked"))
    ends = links.join(codes, "linked", "left_anti")
    own = ends.join(inner.select("code"), "code", "left_anti").select("code", "linked", F.lit(1).alias("steps"))
    over = ends.join(inner, "code").selectExpr("head AS code", "linked", "steps + 1 AS steps")
    return own.unionByName(over)


def variants_closure(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(code, hops): codes reachable over ``links(code, linked)`` from ``seeds(code)``, with the least number of links.

    Missing codes are ignored.  A small frontier is broadcast to its links, a large one
    is joined by shuffle with adaptive splitting.  Rounds go on until nothing gets
    nearer, however far.
    """
    spark = seeds.sparkSession
    kind = seeds.schema["code"].dataType.simpleString()
    start = seeds.where("code IS NOT NULL").select("code").distinct()
    every = _stored(links.select("code", "linked").where("code <> linked").distinct(), "links")
    inner = _stored(chains(every, start), "chains")
    edges = Parted(spark, "edges", f"code {kind}, linked {kind}, steps int")
    edges.append(contracted(every, inner), "code", SPLITS)
    reached = Parted(spark, "reached", f"code {kind}, hops int")
    frontier = _stored(start.withColumn("hops", F.lit(0)), "frontier")
    if frontier.isEmpty():
        return frontier
    while not frontier.isEmpty():
        reached.append(frontier, "code")
        frontier = _stored(_nearer(frontier, edges, reached), "frontier")
    nearest = reached.all().groupBy("code").agg(F.min("hops").alias("hops"))
    within = inner.join(nearest.withColumnRenamed("code", "head"), "head").selectExpr("code", "hops + steps AS hops")
    return nearest.unionByName(within)


def _nearer(frontier: DataFrame, edges: Parted, reached: Parted) -> DataFrame:
    """Codes one link from the frontier that were not reached yet, or not as near."""
    step = edges.of(frontier, "code").join(small_side(frontier), "code").selectExpr("linked AS code", "hops + steps AS hops")
    found = _stored(step.groupBy("code").agg(F.min("hops").alias("hops")), "found")
    known = reached.of(found, "code").groupBy("code").agg(F.min("hops").alias("known"))
    return found.join(known, "code", "left").where("known IS NULL OR hops < known").select("code", "hops")

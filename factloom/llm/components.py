"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.durable import durable


#: Parts that a node's rows are dealt to when they meet its minimum.
SALTS = 8


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (u, v) joined to ``least`` (u, m): a hub's rows are spread over SALTS tasks."""
    salted = rows.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    every = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["u", "s"]).drop("s")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every node of ``edges`` (a, b); comp is the least id of its component.

    Each round links every node to the least node it sees: large-star moves greater neighbours, small-star lesser ones.
    The edge count never grows and the depth of the trees shrinks geometrically. A hub's rows are aggregated to
    their minimum and meet it in several tasks.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, lower)
        e = durable(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # done when every node points at a root: no node is both a child and a parent, and each child has one parent
        if tuple(mark) == last or mark[0] == 0:
            break
        last = tuple(mark)
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())

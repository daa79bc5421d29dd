"""Constraint operators: each returns the rows that break a rule, so that an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import on_boundary


def contract(schema: str, snapshot_id: str, producer: str) -> Column:
    """What is wrong with a document of facts (schema, snapshot_id, producer); null if it is the one asked for."""
    other = ~F.col("schema").eqNullSafe(schema) | ~F.col("snapshot_id").eqNullSafe(snapshot_id)
    got = F.concat(F.lit("worker_producer_not_supported:got="), F.coalesce("producer", F.lit("")), F.lit(f":expected={producer}"))
    return F.when(other, "language_contract_mismatch").when(~F.col("producer").eqNullSafe(producer), got)


def coverage(expected: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """(path, problem): expected but missing, acknowledged but invented, acknowledged twice."""
    missing = expected.select("path").distinct().join(acknowledged.select("path"), "path", "left_anti").withColumn("problem", F.lit("missing"))
    invented = acknowledged.select("path").distinct().join(expected.select("path"), "path", "left_anti").withColumn("problem", F.lit("invented"))
    twice = acknowledged.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("duplicate").alias("problem"))
    return missing.unionByName(invented).unionByName(twice)


def outside(rows: DataFrame, inputs: DataFrame) -> DataFrame:
    """Rows (path, ...) whose path is no input."""
    return rows.join(inputs.select("path"), "path", "left_anti")


def bad_symbols(symbols: DataFrame) -> DataFrame:
    """(id, problem): repeated ids, and ids that do not follow from path and span."""
    twice = symbols.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    formula = F.concat_ws(":", F.lit("symbol"), "path", F.col("start").cast("string"), F.col("end").cast("string"))
    return twice.unionByName(symbols.where(F.col("id") != formula).select("id", F.lit("formula").alias("problem")))


def span_ok(text: str = "text") -> Column:
    """Whether start <= end <= length and both are character borders."""
    t = F.col(text)
    return (F.col("start") <= F.col("end")) & on_boundary(t, F.col("start")) & on_boundary(t, F.col("end"))


def over_budget(functions: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(offenders, kept): files with a function above ``limit`` bytes are withheld whole; each is reported by its first offender."""
    size = F.col("end") - F.col("start")
    bad = functions.where(size > limit).groupBy("path").agg(F.min_by("id", "start").alias("first"), F.max(size).alias("largest"), F.count("*").alias("n"))
    return bad, functions.join(bad.select("path"), "path", "left_anti")

"""Relations that several queries begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import catalog, graph
from factloom.sources import projections
from factloom.sources.tables import table


def cat(spark: SparkSession, d: str) -> DataFrame:
    return projections.catalog(spark, d)


def sym(spark: SparkSession, d: str) -> DataFrame:
    return projections.symbols(cat(spark, d))


def bad(spark: SparkSession, d: str) -> DataFrame:
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return cat(spark, d).join(toxic, "doc_id", "left_semi").select("path")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    s = sym(spark, d)
    return graph.resolve_calls(projections.call_sites(s), s, bad(spark, d))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_edges(resolved(spark, d))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.nodes(cat(spark, d), sym(spark, d))


def imports(spark: SparkSession, d: str) -> DataFrame:
    return projections.imports(cat(spark, d), table(spark, d, "documents").count())


def import_paths(spark: SparkSession, d: str) -> DataFrame:
    """imports with target_path."""
    to = cat(spark, d).select(F.col("doc_id").alias("target_doc"), F.col("path").alias("target_path"))
    return imports(spark, d).join(to, "target_doc", "left")


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """A markdown file per conversation: a heading per turn, every fifth body fenced."""
    c = table(spark, d, "conversations")
    body = F.when(F.col("turn") % 5 == 4, F.lit("```\n# not a heading\n```")).otherwise(F.col("text"))
    part = F.concat(F.lit("# "), "role", F.lit("\n"), body)
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("p"))
    return rows.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(F.transform("p", lambda x: x.p), "\n").alias("text"))

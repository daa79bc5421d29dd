"""Graph assembly: call resolution, edges, validation and per-pair counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_calls(calls: DataFrame, symbols: DataFrame, bad_files: DataFrame) -> DataFrame:
    """``calls`` with target and basis. A target is the only symbol of the label, if the call is by identifier and neither
    file is bad; what is unresolved keeps a null target and says why."""
    named = symbols.groupBy(F.col("name").alias("label")).agg(F.count("*").alias("n"), F.min("id").alias("found"), F.min("path").alias("found_path"))
    bad = bad_files.select(F.col("path").alias("bad_path")).distinct()
    rows = calls.join(named, "label", "left")
    rows = rows.join(bad.withColumnRenamed("bad_path", "path").withColumn("bad", F.lit(True)), "path", "left")
    rows = rows.join(bad.withColumnRenamed("bad_path", "found_path").withColumn("bad_target", F.lit(True)), "found_path", "left")
    basis = (
        F.when(F.col("form") != "identifier", "not_identifier")
        .when(F.col("bad"), "bad_file")
        .when(F.col("n").isNull(), "missing")
        .when(F.col("n") > 1, "ambiguous")
        .when(F.col("bad_target"), "bad_target_file")
        .otherwise("resolved")
    )
    return rows.withColumn("basis", basis).withColumn("target", F.when(F.col("basis") == "resolved", F.col("found"))).drop("n", "found", "found_path", "bad", "bad_target")


def call_edges(resolved: DataFrame) -> DataFrame:
    return resolved.select("id", F.col("owner").alias("source"), "target", F.lit("call_candidate").alias("kind"), "path", "label", "basis")


def contains_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent IS NOT NULL").select(
        F.concat(F.lit("contains:"), "id").alias("id"),
        F.col("parent").alias("source"),
        F.col("id").alias("target"),
        F.lit("contains").alias("kind"),
        "path",
        F.lit(None).cast("string").alias("label"),
        F.lit("containment").alias("basis"),
    )


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges; a type import is told apart; an unresolved target stays null."""
    to = files.select(F.col("doc_id").alias("target_doc"), F.concat(F.lit("file:"), "path").alias("target"))
    return imports.join(to, "target_doc", "left").select(
        "id",
        F.concat(F.lit("file:"), "path").alias("source"),
        "target",
        F.when(F.col("type_only"), "type_import").otherwise("import").alias("kind"),
        "path",
        F.lit(None).cast("string").alias("label"),
        F.when(F.col("target").isNull(), "unresolved").otherwise("resolved").alias("basis"),
    )


def pair_counts(edges: DataFrame, a: str, b: str) -> DataFrame:
    """How many edges cross from one group to another, most first."""
    return edges.where(F.col(a) != F.col(b)).groupBy(F.col(a).alias("from"), F.col(b).alias("to")).agg(F.count("*").alias("n"))


def inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Range join of spans: pairs of ``inner`` spans and the ``outer`` spans of the same path that hold them, not themselves."""
    o = outer.select("path", F.col("id").alias("outer_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    hold = (F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end")) & (F.col("outer_id") != F.col("id"))
    return inner.join(o, "path").where(hold)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, problem): edges whose endpoint is no node, and ids that occur twice."""
    ids = nodes.select("id")
    no_source = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select("id", F.lit("source").alias("problem"))
    no_target = edges.where("target IS NOT NULL").join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select("id", F.lit("target").alias("problem"))
    twice = edges.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    return no_source.unionByName(no_target).unionByName(twice)

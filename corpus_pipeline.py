"""A corpus pipeline of five stages over ``documents``.

Toxic documents go, one document of each group of near copies stays, documents with benchmark passages go, secrets are masked
in the texts that stay, and what is left is packed into sequences. Each stage is written to the shared folder and reread by the next.

Null and empty texts are kept by every stage and packed as an end token; texts of any length are worked on whole; of rows equal in every
column one stays; of near copies with one doc_id the least row by content; an empty table gives no rows; all but the last stage keep
all columns, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, ngram_join, packing, secrets, toxicity
from factloom.llm.durable import durable
from factloom.llm.entries import tokenizer_path
from factloom.llm.tables import named, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; learned from the labelled rows of ``docs``."""
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    column = unused(docs, "toxicity")
    return toxicity.score(docs, grammar, column).where(F.col(column) < 0.5).drop(column)


def _row(docs: DataFrame) -> Column:
    """A number that follows from a row's content alone: it stays the same however often, and on whatever executors, files are read."""
    return F.xxhash64(*[F.to_json(F.struct(named(f.name))) if "map<" in f.dataType.simpleString() else named(f.name) for f in docs.schema.fields])


def _kept(docs: DataFrame, rows: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``rows`` (row, doc_id) names; ``once``: of equal rows one."""
    named = rows.select(F.col("row").alias("r"), F.col("doc_id").alias("d"))
    number = unused(docs, "row")
    marked = docs.withColumn(number, _row(docs))
    kept = marked.join(named, (marked[number] == named.r) & marked.doc_id.eqNullSafe(named.d), "left_semi")
    return (kept.dropDuplicates([number, "doc_id"]) if once else kept).drop(number)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id, and of equal rows one."""
    classes = ngram_join.similar(docs, row=_row(docs))
    first = classes.groupBy("root", F.when(F.col("root").isNull(), F.col("row"))).agg(F.min(F.struct("doc_id", "row")).alias("m"))
    return _kept(docs, first.select("m.*"), once=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), row=_row(docs))
    return _kept(docs, found.where("n_hit = 0"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path()).drop("row")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The stages are beyond SQL; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

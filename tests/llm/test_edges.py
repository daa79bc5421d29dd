"""Nulls in every column, repeated rows, columns of clashing names and empty tables, through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import context_tree, decontaminate, entries, licenses, main_text, ngram_join, packing, preference, secrets, toxicity, vptree

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "some words that say nothing of note at all today", "en", "s", 49),
    (1, "some words that say nothing of note at all today", "en", "s", 49),
    (1, "other words under the same number", None, None, None),
    (None, "a row without a number, and password=abcdef1", "en", "s", 44),
    (2, None, "en", None, 0),
    (3, "", None, "s", 0),
    (4, "word " * 30_000, "en", "s", 150_000),
]
EXTRA = ("row", "Row_", "toxicity", "fp", "hash", "whole", "spans", "kind", "d", "r", "band", "m")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, odd):
    """A folder of tables: odd documents, and the others empty."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    for name, schema in {
        "benchmark": "item_id long, text string, words string, hash long",
        "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string",
        "embeddings": "vec_id long, embedding array<float>, label int",
        "conversations": "conv_id long, turn long, role string, text string, last long",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_operators_give_a_row_per_document(spark, odd):
    n = len(ROWS)
    items = spark.createDataFrame([(1, None), (None, "other words"), (2, "")], "item_id long, text string")
    assert secrets.scan(odd).count() == n
    assert licenses.scan(odd).count() == n
    assert context_tree.score(odd, depth=2).count() == n
    assert ngram_join.similar(odd).count() == n
    assert {r.doc_id: r.n_hit for r in decontaminate.decontaminate(odd, items).where("n_hit > 0").collect()} == {1: 2}
    assert toxicity.score(odd, toxicity.Grammar(), "t").count() == n
    assert packing.pack(odd, entries.tokenizer_path()).where("piece = 0").count() == n
    assert sorted((r.doc_id or 0, r.n_links) for r in ngram_join.similar(odd).collect()) == [(0, 0), (1, 0), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0)]


def test_stages_keep_the_columns(spark, odd, tables):
    docs, left = odd, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == odd.columns
        left.append(docs.count())
    assert left == [len(ROWS), len(ROWS) - 1, len(ROWS) - 1, len(ROWS) - 1]
    assert docs.where("doc_id IS NULL").first().text.endswith("and [REDACTED]")


def test_queries_on_odd_and_empty_tables(spark, tables):
    for name, q in entries.QUERIES.items():
        rows = q(spark, tables).count()
        assert rows == 0 if name.startswith(("op2_", "op3_", "op9_")) else rows >= len(ROWS) - 1, name


def test_no_documents(spark, tables, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    for name in ("benchmark", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    for name, q in entries.QUERIES.items():
        assert q(spark, d).count() == 0, name


def test_odd_vectors_pages_and_turns(spark):
    v = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0]), (1, []), (2, None), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = vptree.nearest(v.withColumn("v", F.lit(1)).withColumn("row", F.lit(1)), lambda i: i % 20 == 0, k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(20, 1, 3), (20, 1, 3), (20, 2, 20), (20, 2, 20)]
    p = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (1, "u", "")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in main_text.extract(p.withColumn("text", F.lit("no"))).collect()) == [("", 0), ("", 0), ("x", 1)]
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert preference.preferences(*preference.neighbour_pairs(t.withColumn("last", F.lit(1)).withColumn("other", F.lit(2)))).count() == 1

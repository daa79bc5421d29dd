"""The pipeline's stages: their decisions against brute force, and its whole run."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from factloom.llm import entries, toxicity
from tests.llm.test_llm_operators import brute_hits, brute_links, docs_of

SF = "/root/testdata/sf0.001"


def test_near_copies_keep_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    again = docs.limit(5)
    kept = corpus_pipeline.drop_near_copies(spark, docs.unionByName(again), SF)
    assert kept.columns == docs.columns
    classes = defaultdict(list)
    for i, (c, _) in enumerate(brute_links([r.text for r in rows])):
        classes[c].append(rows[i].doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(v) for v in classes.values())


def test_empty_texts_are_no_copies(spark):
    docs = docs_of(spark, [None, "", "a b c d e f", "A b, c d e f!"])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 1, 2]


def test_contaminated_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = docs.collect()
    clean = sorted(r.doc_id for r, (_, hit, _) in zip(rows, brute_hits([r.text for r in rows], items), strict=True) if not hit)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()) == clean


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    grammar = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    s = grammar.scorer()
    assert kept == {r.doc_id for r in docs.collect() if s.score(s.features(r.text)) < 0.5}


@pytest.mark.parametrize("columns", ["doc_id, text, lang, source, n_chars"])
def test_whole_run(spark, columns):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert ", ".join(docs.columns) == columns
    left = {r.doc_id: r.text for r in docs.collect()}
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in left.values())
    packed = entries.pipeline(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(left)
    per = defaultdict(int)
    for r in packed:
        per[r.sequence_id] += r.length
    assert max(per.values()) <= 2048

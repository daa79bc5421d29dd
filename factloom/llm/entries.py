"""The registered queries of this subpackage: thin, each applying one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import alignment, context_tree, decontaminate, fill_middle, licenses, main_text, ngram_join, packing, preference, secrets, token_transducer, toxicity, vptree
from factloom.llm.tables import table

TOKENIZER = os.environ.get("FACTLOOM_TOKENIZER", "")


def tokenizer_path() -> str:
    """The vocabulary file: the FACTLOOM_TOKENIZER variable, or the public tokenizers' 49k words."""
    return TOKENIZER or public_path("word_bpe_49k.json")


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    strong = F.filter("spans", lambda s: s.kind.isin(secrets.STRONG))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, secrets.STRONG), F.sha2(text(strong), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preferences(*preference.neighbour_pairs(table(spark, sf_dir, "conversations")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxicity.held_out(F.col("doc_id"), 5).alias("held_out"), "text")
    scored = toxicity.score(rows, grammar).withColumnRenamed("toxicity", "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents")).drop("row", "root")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_transducer.counts(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.alignment(docs, public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")).drop("row")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_chat_formatting,
        op3_nearest_neighbours,
        op4_toxicity,
        op5_lm_scoring,
        op6_license_scan,
        op7_packing,
        op8_decontamination,
        op9_main_text,
        op10_ngram_jaccard,
        op11_token_counts,
        op12_fill_middle,
        op13_tokenizer_alignment,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": preference.ORACLE,
    "op6_license_scan": licenses.oracle(),
    "op8_decontamination": decontaminate.ORACLE,
    "op10_ngram_jaccard": ngram_join.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
}

"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of an item (an item of fewer words, but not none, is one window).
Exact containment of a window needs all its tokens, so one prefix token is enough: the window's rarest, by
counts over all documents. Document words that are the prefix token of some window are joined to those
windows by word hash; the token's place in the window and the document's length bound where the window would
lie, and the words there are compared one by one. The document words inside any occurrence are hit.

Null texts have no words; a row keeps its own result even if its doc_id repeats; an empty table on either side
gives rows without hits (or no rows); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.durable import durable
from factloom.llm.kernels import Bitmap, Words, chunks, signed, signed_slot_sql
from factloom.llm.tables import WORDS_SQL

WIDTH = 10


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, window, word[], hash[]) of every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets)
                for r in range(len(offsets) - 1):
                    a, b = int(w.bounds[r]), int(w.bounds[r + 1])
                    item = batch.column("item_id")[first + r].as_py()
                    words = [w.word(i).decode("utf-8", "replace") for i in range(a, b)]
                    hashes = signed(w.hashes[a:b]).tolist()
                    for k in range(max(1, b - a - width + 1) if b > a else 0):
                        rows.append((item, words[k : k + width], hashes[k : k + width]))
            yield pa.RecordBatch.from_pylist(
                [{"item_id": i, "words": x, "hashes": h} for i, x, h in rows],
                pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64()))]),
            )

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        cut, "item_id long, words array<string>, hashes array<long>"
    )


def _slots(df: DataFrame, column: str) -> Bitmap:
    return Bitmap.of(df, F.expr(signed_slot_sql(column)))


def _counts(docs: DataFrame, vocabulary: Bitmap) -> DataFrame:
    """(hash, n): how often words whose slot is in the bitmap occur in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value.flags()
        seen: dict[str, np.ndarray] = {"h": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64)}

        def merge(h: np.ndarray, n: np.ndarray) -> None:
            keys, back = np.unique(np.concatenate([seen["h"], h]), return_inverse=True)
            seen["n"] = np.bincount(back, np.concatenate([seen["n"], n]), len(keys)).astype(np.int64)
            seen["h"] = keys

        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                h = Words(data, offsets).hashes
                merge(*np.unique(h[flags[Bitmap.slots(h)]], return_counts=True))
                if len(seen["h"]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([signed(seen["h"]), seen["n"]], ["hash", "n"])
                    seen = {"h": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64)}
        yield pa.RecordBatch.from_arrays([pa.array(signed(seen["h"])), pa.array(seen["n"])], ["hash", "n"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "hash long, n long")
    return parts.groupBy("hash").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, prefix: Bitmap, width: int, row: Column) -> DataFrame:
    """A row per document (pos -1) and one per word that may be a prefix token, with the ``width - 1`` words on both sides."""
    held = docs.sparkSession.sparkContext.broadcast(prefix)
    schema = "row long, doc_id long, n_words long, hash long, pos int, at int, around string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value.flags()
        for batch in batches:
            ids = batch.column("doc_id").to_pandas()
            rows = batch.column("row").to_numpy()
            for first, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets)
                n = np.diff(w.bounds)
                hits = np.flatnonzero(flags[Bitmap.slots(w.hashes)])
                doc = np.searchsorted(w.bounds, hits, "right") - 1
                a = np.maximum(w.bounds[doc], hits - width + 1)
                b = np.minimum(w.bounds[doc + 1], hits + width)
                around = [" ".join(w.word(j).decode("utf-8", "replace") for j in range(x, y)) for x, y in zip(a, b, strict=True)]
                k = np.arange(first, first + len(n))
                # heads never match a window: their key is spread over partitions by row
                out = pd.DataFrame(
                    {
                        "row": np.concatenate([rows[k], rows[first + doc]]),
                        "n_words": np.concatenate([n, n[doc]]),
                        "hash": np.concatenate([rows[k], signed(w.hashes)[hits]]),
                        "pos": np.concatenate([np.full(len(k), -1), hits - w.bounds[doc]]),
                        "at": np.concatenate([np.full(len(k), -1), hits - a]),
                    }
                )
                cols = [pa.array(out[c]) for c in out]
                who = pa.array(pd.concat([ids.iloc[k], ids.iloc[first + doc]]), pa.int64(), from_pandas=True)
                text = pa.array([None] * len(k) + around, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [cols[0], who, cols[1].cast(pa.int64()), cols[2], cols[3].cast(pa.int32()), cols[4].cast(pa.int32()), text],
                    ["row", "doc_id", "n_words", "hash", "pos", "at", "around"],
                )

    return docs.select(
        row.alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    ).mapInArrow(find, schema)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, row: Column | None = None) -> DataFrame:
    """Per row of ``docs``: row (a long of the caller's, or a running number; rows of one number are one), doc_id, n_words, n_hit, n_items, items (sorted as strings), hits (start, end in words)."""
    windows = durable(_windows(items, width))
    tokens = windows.select("item_id", "words", F.posexplode("hashes").alias("place", "hash"))
    counts = _counts(docs, _slots(windows.select(F.explode("hashes").alias("h")), "h"))
    by_rarity = F.struct(F.coalesce("n", F.lit(0)), "hash", "place")
    rarest = durable(
        tokens.join(counts, "hash", "left")
        .groupBy("words")
        .agg(F.min(by_rarity).alias("r"), F.collect_set("item_id").alias("items"))
        .select(F.col("r.hash").alias("hash"), F.col("r.place").alias("place"), "words", "items")
    )
    places = _places(docs, _slots(rarest, "hash"), width, F.monotonically_increasing_id() if row is None else row)
    found = places.join(rarest, "hash", "left").withColumn(
        "hit",
        (F.col("pos") >= F.col("place"))
        & (F.col("pos") - F.col("place") + F.size("words") <= F.col("n_words"))
        & (F.slice(F.split("around", " "), F.greatest(F.col("at") - F.col("place"), F.lit(0)) + 1, F.size("words")) == F.col("words")),
    )
    start = F.col("pos") - F.col("place")
    whole = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("hit"), F.struct(start.alias("start"), (start + F.size("words")).alias("end"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit"), F.transform("items", lambda i: i.cast("string"))))))).alias("items"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, h: F.struct(
            (acc.n + F.greatest(F.lit(0), h.end - F.greatest(h.start, acc.to))).cast("long").alias("n"),
            F.greatest(acc.to, h.end.cast("long")).alias("to"),
        ),
    )
    return whole.select("row", "doc_id", "n_words", covered.n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits")


#: DuckDB SQL for the query's rows: every run of a window's length is compared with every window, by equality.
ORACLE = f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents), b AS (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark),
 cut AS (SELECT item_id, ws, unnest(range(greatest(1, len(ws) - {WIDTH - 1}))) AS p FROM b WHERE len(ws) > 0),
 win AS (SELECT DISTINCT item_id, least(len(ws), {WIDTH}) AS k, array_to_string(list_slice(ws, p + 1, p + {WIDTH}), ' ') AS run FROM cut),
 word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
 runs AS (SELECT doc_id, p, k, string_agg(w, ' ') OVER (PARTITION BY doc_id, k ORDER BY p ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING) AS run FROM word, (SELECT DISTINCT k FROM win)),
 hit AS (SELECT DISTINCT doc_id, p, k, item_id FROM runs JOIN win USING (k, run)),
 covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hit)) GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

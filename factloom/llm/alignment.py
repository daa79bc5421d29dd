"""Alignment of two tokenizers' tokens over the corpus.

Each text is encoded by a byte-level BPE (A, with a space in front) and by a SentencePiece model (B, which adds that space), and both
become tables of token intervals in bytes. Offsets where tokens of both end cut them into groups; tokens of one group are linked.

Inside a task, DuckDB takes the tables of a few texts at a time. Tokens of both that have one interval are groups of their own; of those left, an as-of join finds, for each A token, the last B token that ends no later,
hence the common ends; a window sum over those numbers the groups; a range join puts B tokens into the groups' intervals; tokens are
counted by group and id before they are paired, so that a long group of few ids is no square of its length. Each batch's pairs
are counted by document there, and Spark merges these partial counts. A text of many tokens is worked on in slices that end at common ends.

The count of a pair is the number of documents that hold it linked. The pairs of the documents meet these counts in two ways that give the same: the
most frequent ones, at most ``TOP`` of them, are looked up in every task; the others are joined, and none of them is held by more than
a ``TOP``-th of all documents' pairs.

Texts that are null or empty, or whose tokens' bytes are not the text with a space in front, have no tokens: their counts are 0 and groups_sha256
is ''. Texts of any length that a worker's memory holds twenty times are aligned whole; each row is a document of its own, whatever its doc_id; ties for an A
token's most frequent partner all count; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.durable import durable

#: Pairs that every task looks up, at most: 17 bytes each.
TOP = 1 << 18
#: Texts are taken to DuckDB together up to so many bytes, tokens of one text up to so many at a time.
CHUNK_BYTES = 700_000
SLICE = 1_000_000
#: Parts of texts that a worker keeps encoded, of 64 bytes at most: twice so many, and those of one run of texts.
KNOWN = 120_000
#: Counts below are told apart one by one where the most frequent pairs are chosen, those above by 64 steps for each doubling.
FINE = 1024
_ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<long>"
)
_LOOKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, a array<int>, b array<int>, n array<long>"
#: Characters that the two libraries' splitters surely take for the same; other texts are encoded by the tokenizer's own.
_SHARED = re.compile(r"[\x00-ɏΑ-Ωα-ωА-я‐-‧‰-›ぁ-ゖァ-ヺ一-龥가-힣]*")


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import json

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = json.loads(self.a.to_str())["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        byte_of = {chr(b) if b in printable else chr(next(spare)): b for b in range(256)}
        raw = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items() if all(c in byte_of for c in t)}
        self.bytes_a = [raw.get(i, b"") for i in range(max(raw) + 1)]
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {raw[i]: i for t, i in vocabulary.items() if i in raw and t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: byte-level BPE's public splitting pattern
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        #: A token's digits with what follows it: its own side's next, the other side.
        self.text_a = np.array([s for i in range(len(self.bytes_a)) for s in (f"{i},", f"{i}|")], object)
        self.text_b = np.array([s for i in range(len(self.bytes_b)) for s in (f"{i},", f"{i};")], object)

        #: Whether no piece goes on over a blank: then no merge does, and parts before blanks are encoded for themselves.
        self.parted = all("▁" not in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.known: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.older: dict[bytes, tuple[bytes, bytes] | None] = {}

    def _whole(self, raw: bytes) -> tuple[bytes, bytes] | None:
        """Token ids of both of a text with a space in front, as 32-bit numbers; None where a side's bytes are others."""
        spaced = raw.decode()
        a = self.fast.encode_ordinary(spaced) if _SHARED.fullmatch(spaced) else self.a.encode(spaced, add_special_tokens=False).ids
        b = self.b.encode(spaced[1:], num_threads=1)
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        return np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Token ids of both of each text; of neither where a side's bytes are not the text with a space in front. A blank behind a visible ASCII character
        begins a word and a piece, so that parts between such places are encoded once and kept."""
        raws = [(" " + t).encode() if t else b"" for t in texts]
        parts = [self._parts(r) if self.parted else [r] for r in raws]
        self._learn(dict.fromkeys(p for some in parts for p in some))
        none = np.zeros(0, np.int32)
        out = []
        for raw, some in zip(raws, parts, strict=True):
            found = [self.known[p] if p in self.known else self._part(p) for p in some] if raw else [None]
            if None in found:  # parts that differ may still be a text that does not
                whole = self._whole(raw) if len(some) > 1 else None
                out.append((none, none) if whole is None else tuple(np.frombuffer(x, np.int32) for x in whole))
            else:
                out.append(tuple(np.frombuffer(b"".join(x), np.int32) for x in zip(*found, strict=True)))
        return out

    @staticmethod
    def _parts(raw: bytes) -> list[bytes]:
        at = np.frombuffer(raw, np.uint8)
        ends = [0, *(np.flatnonzero((at[1:] == 32) & (at[:-1] > 32) & (at[:-1] < 127)) + 1).tolist(), len(raw)]
        return [raw[i:j] for i, j in pairwise(ends)]

    def _learn(self, parts: Iterable[bytes]) -> None:
        """Encode short parts that are not known, many at a time: written together, those that end in a visible ASCII character keep their tokens."""
        new = []
        for p in parts:
            if p in self.older:
                self.known[p] = self.older[p]
            elif p not in self.known and 1 < len(p) <= 64 and 32 < p[-1] < 127:
                new.append(p)
        for first in range(0, len(new), 512):
            some = new[first : first + 512]
            whole = self._whole(b"".join(some))
            if whole is not None:  # else each is tried for itself
                ends = np.cumsum([len(p) for p in some])
                cuts = [[0, *(4 * (np.searchsorted(np.cumsum(size[np.frombuffer(ids, np.int32)]), ends) + 1)).tolist()] for ids, size in zip(whole, (self.size_a, self.size_b), strict=True)]
                for p, (i, j), (k, m) in zip(some, pairwise(cuts[0]), pairwise(cuts[1]), strict=True):
                    self.known[p] = whole[0][i:j], whole[1][k:m]

    def _part(self, raw: bytes) -> tuple[bytes, bytes] | None:
        ids = self.older[raw] if raw in self.older else self._whole(raw)
        if len(raw) <= 64:
            self.known[raw] = ids
        return ids

    def forget(self) -> None:
        """Between runs of texts: of more than KNOWN parts, those that were met since the last time stay within reach."""
        if len(self.known) >= KNOWN:
            self.known, self.older = {}, self.known


_loaded: dict[tuple[str, str], Pair] = {}


def tokenizers(path_a: str, path_b: str) -> Pair:
    """One pair per Python worker, kept between its tasks."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair(path_a, path_b)
    return _loaded[path_a, path_b]


#: Tokens of A and B with one interval are a group by themselves; the others are left, none of whose ends is one of theirs.
_SAME = "CREATE OR REPLACE TEMP TABLE same AS SELECT a.doc, a.id AS a, b.id AS b, a.e FROM a JOIN b ON a.s = b.s AND a.e = b.e"
_LEFT_A = "CREATE OR REPLACE TEMP TABLE la AS SELECT a.doc, a.id, a.e FROM a ANTI JOIN same ON a.e = same.e"
_LEFT_B = "CREATE OR REPLACE TEMP TABLE lb AS SELECT b.id, b.e FROM b ANTI JOIN same ON b.e = same.e"
#: A's tokens with the group of each: a group ends where a B token ends with an A token.
_GROUPS_A = """
CREATE OR REPLACE TEMP TABLE ga AS
SELECT doc, id, e, cut, CAST(sum(CAST(cut AS INT)) OVER (ORDER BY e) - CAST(cut AS INT) AS INT) AS g
FROM (SELECT la.doc, la.id, la.e, coalesce(lb.e = la.e, false) AS cut FROM la ASOF LEFT JOIN lb ON la.e >= lb.e)
"""
_INTERVALS = "CREATE OR REPLACE TEMP TABLE groups AS SELECT g, lag(e, 1, 0) OVER (ORDER BY e) AS s, e FROM ga WHERE cut"
_GROUPS_B = "CREATE OR REPLACE TEMP TABLE gb AS SELECT lb.id, groups.g FROM lb JOIN groups ON lb.e > groups.s AND lb.e <= groups.e"
_LINKS = """
INSERT INTO links
WITH na AS (SELECT doc, g, id, count(*) AS n FROM ga GROUP BY ALL), nb AS (SELECT g, id, count(*) AS n FROM gb GROUP BY ALL),
     found AS (SELECT doc, a, b, 1 AS n FROM same UNION ALL SELECT doc, na.id, nb.id, na.n * nb.n FROM na JOIN nb USING (g))
SELECT doc, a, b, CAST(sum(n) AS BIGINT) AS n FROM found GROUP BY ALL
"""
#: Each group's tokens of A and of B, in order.
_SIZES = """
SELECT doc, na, nb FROM (
  SELECT doc, 1 AS na, 1 AS nb, e FROM same
  UNION ALL SELECT x.doc, x.n, y.n, x.e FROM (SELECT g, min(doc) AS doc, count(*) AS n, max(e) AS e FROM ga GROUP BY g) x JOIN (SELECT g, count(*) AS n FROM gb GROUP BY g) y USING (g)
) ORDER BY e
"""


class Aligner:
    """Groups and links of a few texts at a time, by DuckDB in this worker's memory."""

    def __init__(self, pair: Pair, slice_tokens: int = SLICE) -> None:
        import duckdb

        self.pair, self.slice_tokens = pair, slice_tokens
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
        self.db.execute("SET merge_join_threshold = 0")  # range joins by sorted ranges whatever sizes are guessed
        self.db.execute("CREATE TEMP TABLE links (doc INT, a INT, b INT, n BIGINT)")

    def _slices(self, end_a: np.ndarray, end_b: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """Runs of about ``slice_tokens`` of A's tokens, and B's beside them, that end at common ends."""
        i = j = 0
        while i < len(end_a):
            width, at = self.slice_tokens, None
            while at is None:  # the last end of all is common
                window = end_a[i : i + width]
                common = np.intersect1d(window, end_b[np.searchsorted(end_b, window[0]) : np.searchsorted(end_b, window[-1], "right")], assume_unique=True)
                at = common[-1] if len(common) else None
                width *= 2
            to_a, to_b = (int(np.searchsorted(e, at)) + 1 for e in (end_a, end_b))
            yield slice(i, to_a), slice(j, to_b)
            i, j = to_a, to_b

    def align(self, texts: list[str]) -> tuple[pa.Table, pa.Table | None]:
        """Of each text its counts, its groups' digest and its pairs (a, b, n as lists), and in one row how many of the texts hold each pair (a, b, n)."""
        pair = self.pair
        pair.forget()
        encoded = pair.encode(texts)
        sizes_a, sizes_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.concatenate([e[k] for e in encoded]) for k in (0, 1))
        del encoded
        groups = np.zeros(len(texts), np.int64)
        if not len(ids_a):
            none = [0] * len(texts)
            return pa.table({**dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), none), "groups_sha256": [""] * len(texts), **dict.fromkeys("abn", [[] for _ in texts])}), None
        end_a, end_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes_a)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.db.execute("DELETE FROM links")
        slices = 0
        for of_a, of_b in self._slices(end_a, end_b):
            base = int(end_a[of_a.start - 1]) if of_a.start else 0
            # the tables are named here for DuckDB
            ends = [(end[of] - base).astype(np.int32) for end, of in ((end_a, of_a), (end_b, of_b))]
            starts = [np.concatenate([np.zeros(1, np.int32), e[:-1]]) for e in ends]
            a = pa.table({"doc": doc[of_a], "id": ids_a[of_a], "s": starts[0], "e": ends[0]})  # noqa: F841
            b = pa.table({"id": ids_b[of_b], "s": starts[1], "e": ends[1]})  # noqa: F841
            for query in (_SAME, _LEFT_A, _LEFT_B, _GROUPS_A, _INTERVALS, _GROUPS_B, _LINKS):
                self.db.execute(query)
            found = self.db.execute(_SIZES).fetchnumpy()
            parts.append((found["na"].astype(np.int64), found["nb"].astype(np.int64)))
            groups += np.bincount(found["doc"], minlength=len(texts))
            slices += 1
        merged = "links" if slices == 1 else "(SELECT doc, a, b, CAST(sum(n) AS BIGINT) AS n FROM links GROUP BY doc, a, b)"
        counted = self.db.execute(f"SELECT a, b, count(*) AS n FROM {merged} GROUP BY a, b").fetchnumpy()
        linked = self.db.execute(f"SELECT doc, a, b, n FROM {merged} ORDER BY doc").fetchnumpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(linked["doc"], minlength=len(texts)))]), pa.int32())
        pairs = {c: pa.ListArray.from_arrays(offsets, pa.array(linked[c])) for c in "abn"}
        links = np.bincount(linked["doc"], linked["n"], len(texts)).astype(np.int64)
        digests = self._digests(ids_a, ids_b, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), groups)
        return pa.table({"n_a": sizes_a, "n_b": sizes_b, "n_groups": groups, "n_links": links, "groups_sha256": digests, **pairs}), pa.table({c: [counted[c]] for c in "abn"})

    def _digests(self, ids_a: np.ndarray, ids_b: np.ndarray, na: np.ndarray, nb: np.ndarray, groups: np.ndarray) -> list[str]:
        """SHA-256 of the groups' text of each document: a group's A ids, then its B ids."""
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[np.cumsum(na) - 1] = True
        last_b[np.cumsum(nb) - 1] = True
        # where a token stands among all: its own number, and the other side's tokens before it
        place_a = np.arange(len(ids_a)) + np.repeat(np.cumsum(nb) - nb, na)
        place_b = np.arange(len(ids_b)) + np.repeat(np.cumsum(na), nb)
        text = np.empty(len(ids_a) + len(ids_b), object)
        text[place_a] = self.pair.text_a[2 * ids_a + last_a]
        text[place_b] = self.pair.text_b[2 * ids_b + last_b]
        ends = np.concatenate([[0], np.cumsum(na + nb)])[np.cumsum(groups)]
        out, at = [], 0
        for end in ends.tolist():
            out.append(hashlib.sha256("".join(text[at:end].tolist())[:-1].encode()).hexdigest() if end > at else "")
            at = end
        return out


def _runs(texts: pa.Array, limit: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        text = t.as_py() or ""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def align(docs: DataFrame, path_a: str, path_b: str, slice_tokens: int = SLICE) -> DataFrame:
    """Per document row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and its linked id pairs (a, b, n occurrences as arrays), and per run of
    documents one row without a ``row``: how many of its documents hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers(path_a, path_b), slice_tokens)
        schema = pa.schema([*((c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), *((c, pa.list_(k)) for c, k in (("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())))])
        for batch in batches:
            for first, texts in _runs(batch.column("text"), CHUNK_BYTES):
                found, counted = aligner.align(texts)
                ids = [batch.column(c).slice(first, len(texts)) for c in ("row", "doc_id")]
                whole = pa.table([*ids, *found.columns], ["row", "doc_id", *found.column_names]).cast(schema)
                if counted is not None:
                    whole = pa.concat_tables([whole, pa.table([counted[f.name] if f.name in "abn" else pa.nulls(1, f.type) for f in schema], schema.names).cast(schema)])
                yield from whole.combine_chunks().to_batches()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _ALIGNED)


def _bucket() -> F.Column:
    """A number that rises with ``count``: a few thousand values whatever the counts."""
    above = F.floor(F.log2(F.col("count") / FINE) * 64).cast("int")
    return F.when(F.col("count") < FINE, F.col("count").cast("int")).otherwise(FINE + above)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked), best (no partner of ``a`` has a higher count): partial counts merged."""
    parts = aligned.where("row IS NULL").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    counts = durable(parts.groupBy("a", "b").agg(F.sum("n").alias("count")))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def scores(aligned: DataFrame, counts: DataFrame, top: int = TOP) -> DataFrame:
    """Per document of ``aligned`` its counts, digest, n_best and count_sum; ``counts`` as pair_counts gives them."""
    spark = aligned.sparkSession
    counts = counts.withColumn("bucket", _bucket())
    sizes = sorted(counts.groupBy("bucket").count().collect(), key=lambda r: -r["bucket"])
    least, taken = float("inf"), 0
    for r in sizes:
        taken += r["count"]
        if taken > top:
            break
        least = r["bucket"]
    often = counts.where(F.col("bucket") >= least).select("a", "b", "count", "best").toArrow() if least < float("inf") else None

    def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b.astype(np.int64)

    if often is None or not often.num_rows:
        table = np.full(1, -1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)
    else:
        keys = packed(often.column("a").to_numpy(), often.column("b").to_numpy())
        order = np.argsort(keys)
        table = keys[order], often.column("count").to_numpy()[order], often.column("best").to_numpy()[order]
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = shared.value
        for batch in batches:
            lists = [batch.column(c) for c in ("a", "b", "n")]
            size = np.asarray(lists[0].value_lengths())
            a, b, n = (np.asarray(x.flatten()) for x in lists)
            of = np.repeat(np.arange(len(size)), size)
            key = packed(a, b)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            sums = [np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)]
            np.add.at(sums[0], of[hit], n[hit] * best[at[hit]])
            np.add.at(sums[1], of[hit], n[hit] * count[at[hit]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[~hit], minlength=len(size)))]), pa.int32())
            missed = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], k)) for x, k in ((a, pa.int32()), (b, pa.int32()), (n, pa.int64()))]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, sums), *missed], [*names, "n_best", "count_sum", "a", "b", "n"])

    looked = durable(aligned.where("row IS NOT NULL").mapInArrow(run, _LOOKED))
    seldom = counts.where(F.col("bucket") < least).select("a", "b", "count", "best")
    rest = looked.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", "p.*").join(seldom, ["a", "b"])
    more = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum"))
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return looked.drop("a", "b", "n").join(more, "row", "left").select(
        "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256"
    )


def alignment(docs: DataFrame, path_a: str, path_b: str, top: int = TOP) -> DataFrame:
    aligned = durable(align(docs, path_a, path_b))
    return scores(aligned, pair_counts(aligned), top)

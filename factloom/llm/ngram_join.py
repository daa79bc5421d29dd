"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two are linked at a Jaccard similarity of at least ``threshold``.

1. Documents of equal sets are one class of copies (fingerprint of the sorted set) and are compared once.
2. Candidates share a band of MinHash values. With 32 bands of 5 a pair at 0.8 is missed with a chance of 3e-6.
3. Within a bucket, MinHash values are compared 32 at a time; a pair is dropped when the posterior probability
   (uniform prior) that its similarity reaches the threshold falls below ``tolerance``. What is left is kept as a
   spanning forest, never as all pairs; its components are small and tight. A bucket above ``BLOCK`` documents is dealt out:
   all meet its least document in salted parts, those that do not survive with it meet all others as pairs of blocks.
4. Inside a component, each document's shingles arrive once. Pairs that share a band are verified exactly by a
   product of incidence matrices, in blocks; components above ``BLOCK`` documents are dealt as pairs of blocks.
5. Verified links give the classes and each document's number of links; the links themselves are not expanded.

Documents without words (null, empty, only punctuation) have no set: each is its own class without links.
Repeated doc_ids are told apart as rows; ties of class take the smallest doc_id; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.durable import durable
from factloom.llm.kernels import U64, Bitmap, Words, by_key, chunks, mix, shingles, signed
from factloom.llm.tables import WORDS_SQL

SIZE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 32, 5, 32
HASHES = BANDS * ROWS
BLOCK = 2048


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    k = mix(np.arange(1, 2 * HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (k[:HASHES] | U64(1)).astype(np.uint32)[:, None], (k[HASHES:] >> U64(32)).astype(np.uint32)[:, None]


_A, _B = _multipliers()


def _minhash(s: np.ndarray) -> np.ndarray:
    x = (s ^ (s >> U64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, (x[None, k : k + 4096] * _A ^ _B).min(axis=1), out=out)
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, size: int = SIZE, row: Column | None = None) -> DataFrame:
    """Per row of ``docs``: row (a long of the caller's, or a running number), doc_id, fp (of the set of shingles; null if it is empty), sig (8 bits of each MinHash), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=U64)
        for batch in batches:
            fp, sig, bands, n = [], [], [], []
            for _, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets)
                for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
                    s = np.unique(shingles(w.hashes[a:b], size))
                    n.append(len(s))
                    if not len(s):
                        fp.append(None), sig.append(None), bands.append([])
                        continue
                    m = _minhash(s)
                    wide = m.reshape(BANDS, ROWS).astype(U64)
                    key = salt.copy()
                    for r in range(ROWS):
                        key = mix(key * U64(0x9E3779B97F4A7C15) + wide[:, r])
                    fp.append(fingerprint(s)), sig.append(m.astype(np.uint8).tobytes()), bands.append(signed(key).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(n, pa.int64())],
                ["row", "doc_id", "fp", "sig", "bands", "n_shingles"],
            )

    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "row long, doc_id long, fp binary, sig binary, bands array<long>, n_shingles long")


@lru_cache
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n values compared, the fewest matches whose posterior P(similarity >= threshold) is at least ``tolerance``.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1); its upper tail at the threshold is
    the chance of at most m successes in n + 1 trials of probability ``threshold``.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 2)))])
        k = np.arange(n + 2)
        pmf = np.exp(log_fact[n + 1] - log_fact[k] - log_fact[n + 1 - k] + k * np.log(threshold) + (n + 1 - k) * np.log1p(-threshold))
        out[n] = int(np.argmax(np.cumsum(pmf) >= tolerance))
    return out


def survivors(x: np.ndarray, y: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the paired signature rows (broadcast) are left after comparing STEP values at a time."""
    x, y = np.broadcast_arrays(x, y)
    left = np.arange(len(x))
    matches = np.zeros(len(x), np.int32)
    for at in range(0, HASHES, STEP):
        matches[left] += (x[left, at : at + STEP] == y[left, at : at + STEP]).sum(axis=1, dtype=np.int32)
        left = left[matches[left] >= least[at + STEP]]
        if not len(left):
            break
    out = np.zeros(len(x), bool)
    out[left] = True
    return out


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def _tight(sig: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Roots of the components of one bucket's surviving pairs. Pairs inside a known component are not looked at again."""
    n = len(sig)
    f = Forest(n)
    loose = list(range(n))
    while loose:  # a leader takes in what it survives with
        lead, *rest = loose
        ok = survivors(sig[rest], sig[lead], least) if rest else np.zeros(0, bool)
        for k in np.flatnonzero(ok):
            f.join(lead, rest[k])
        if len(rest) and not ok.any() and len(rest) > 64:
            break  # no leader structure here: the blocks below compare what is left
        loose = [r for r, o in zip(rest, ok, strict=True) if not o]
    root = f.roots()
    big = np.bincount(root, minlength=n).argmax()
    others = np.flatnonzero(root != big)
    for i in others:  # pairs across components, each once
        far = np.flatnonzero((root != root[i]) & ((root == big) | (np.arange(n) > i)))
        for k in far[survivors(sig[far], sig[i], least)] if len(far) else ():
            f.join(int(i), int(k))
    return f.roots()


def _linked(buckets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): a spanning forest of the surviving pairs of each bucket. ``buckets``: band, fp, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, tolerance)
        for t in by_key(batches, ["band"]):
            band = t.column("band").to_numpy()
            fp = t.column("fp").to_pylist()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            cut = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
            size = np.diff(cut)
            a: list[bytes] = []
            b: list[bytes] = []
            two = cut[:-1][size == 2]
            for i in two[survivors(sig[two], sig[two + 1], least)] if len(two) else ():
                a.append(fp[i]), b.append(fp[i + 1])
            for i, j in zip(cut[:-1][size > 2], cut[1:][size > 2], strict=True):
                for k, r in enumerate(_tight(sig[i:j], least)):
                    if k != r:
                        a.append(fp[i + r]), b.append(fp[i + k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return buckets.repartition("band").sortWithinPartitions("band").mapInArrow(run, "a binary, b binary")


def _across(sig: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray, least: dict[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the surviving pairs of ``left`` with later rows of ``right``. Rows of equal label are linked already."""
    out = []
    for x in left:
        far = right[(label[right] != label[x]) & (right > x)]
        ok = far[survivors(sig[far], sig[x], least)] if len(far) else far
        for k in ok[np.unique(label[ok], return_index=True)[1]]:
            out.append((int(x), int(k)))
            label[label == label[k]] = label[x]
    return out


def _linked_large(buckets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b) as ``_linked`` gives, of buckets above ``BLOCK`` members. ``buckets``: band, fp, sig, n (members of the band).

    Members that survive with the least one are linked by it and need not meet each other; each other member meets all.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, tolerance)
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig", "lead_sig"))
            ok = survivors(x, y, least) if len(x) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("band", "fp", "sig", "lead")), pa.array(ok)], ["band", "fp", "sig", "lead", "ok"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, tolerance)
        for t in by_key(batches, ["band", "i", "j"]):
            key = np.stack([t.column(c).to_numpy() for c in ("band", "i", "j")])
            cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True]]))
            fp = t.column("fp").to_pylist()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            block, ok = t.column("block").to_numpy(), t.column("ok").to_numpy(zero_copy_only=False)
            a: list[bytes] = []
            b: list[bytes] = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                i, j = key[1:, lo]
                label = np.where(ok[lo:hi], hi - lo, np.arange(hi - lo))
                left, right = (np.flatnonzero(block[lo:hi] == k) for k in (i, j))
                for x, y in _across(sig[lo:hi], left, right, label, least):
                    a.append(fp[lo + x]), b.append(fp[lo + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    lead = buckets.groupBy("band").agg(F.min("fp").alias("lead"), F.first("n").alias("n"))
    lead = lead.join(buckets.select("band", F.col("fp").alias("lead"), F.col("sig").alias("lead_sig")), ["band", "lead"])
    lead = lead.select("band", "lead", "lead_sig", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = buckets.select("band", "fp", "sig", F.expr(f"CAST(pmod(xxhash64(fp), CEIL(n / {BLOCK})) AS INT)").alias("part"))
    seen = durable(dealt.join(lead, ["band", "part"]).mapInArrow(met, "band long, fp binary, sig binary, lead binary, ok boolean"))
    by_lead = seen.where("ok AND fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    per = seen.groupBy("band").agg(F.count_if(~F.col("ok")).alias("loose"), F.count_if("ok").alias("held")).where("loose > 0")
    per = per.select("band", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("loose", "held")))
    rows = seen.select("band", "fp", "sig", "ok").join(per, "band")
    # blocks of loose members are numbered first, so a pair's lesser block is always loose
    place = F.pmod(F.xxhash64("fp"), F.when(F.col("ok"), F.col("held")).otherwise(F.col("loose"))).cast("int")
    rows = rows.withColumn("block", place + F.when(F.col("ok"), F.col("loose")).otherwise(0))
    last = F.col("loose") - 1 + F.when(F.col("ok"), 0).otherwise(F.col("held"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    pairs = rows.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "sig", "ok")
    # by block: the lesser side of a pair of blocks comes first
    pairs = pairs.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "block", "fp")
    return by_lead.unionByName(pairs.mapInArrow(run, "a binary, b binary"))


def _sets(docs: DataFrame, wanted: Bitmap, size: int) -> DataFrame:
    """(fp, shingles) of the documents whose fingerprint's slot is in ``wanted``."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value.flags()
        for batch in batches:
            fp, sets = [], []
            for _, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets)
                for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
                    if b > a:
                        s = np.unique(shingles(w.hashes[a:b], size))
                        f = fingerprint(s)
                        if flags[_slot(f)]:
                            fp.append(f), sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(sets, pa.binary())], ["fp", "shingles"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "fp binary, shingles binary")


def _slot(fp: bytes) -> int:
    return int.from_bytes(fp[:3], "big")


def _incidence(sets: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(shared)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(shared, s)
        at = at[(at < len(shared))]
        hit = np.isin(s, shared, assume_unique=True)
        out[i, np.searchsorted(shared, s[hit])] = 1
    return out


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``x`` with each of ``y``; only shingles of both sides get a column, in slices."""
    out = np.zeros((len(x), len(y)), np.float32)
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    if x is y:
        v, c = np.unique(np.concatenate(x), return_counts=True)
        shared = v[c > 1]
    for k in range(0, len(shared), 4096):
        part = shared[k : k + 4096]
        a = _incidence(x, part)
        out += a @ (a if x is y else _incidence(y, part)).T
    if x is y:
        np.fill_diagonal(out, [len(s) for s in x])
    return out


def _verified(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(fp, root, links) per member and block pair. ``members``: comp, i, j (blocks), block, fp, copies, shingles; sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["comp", "i", "j"]):
            rows = t.to_pydict()
            key = list(zip(rows["comp"], rows["i"], rows["j"], strict=True))
            cut = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
            fp, root, links = [], [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                n = b - a
                sets = [np.frombuffer(x, U64) for x in rows["shingles"][a:b]]
                size = np.array([len(s) for s in sets])
                copies = np.array(rows["copies"][a:b], np.int64)
                side = np.array(rows["block"][a:b]) == rows["i"][a]
                same = rows["i"][a] == rows["j"][a]
                f = Forest(n)
                count = np.zeros(n, np.int64)
                left = np.arange(n) if same else np.flatnonzero(side)
                right = left if same else np.flatnonzero(~side)
                for p in range(0, len(left), 512):
                    for q in range(p if same else 0, len(right), 512):
                        u, v = left[p : p + 512], right[q : q + 512]
                        x = [sets[k] for k in u]
                        both = overlaps(x, x if same and p == q else [sets[k] for k in v]).astype(np.float64)
                        ok = both >= threshold * (size[u][:, None] + size[v][None, :] - both) - 1e-6
                        if same and p == q:
                            ok = np.triu(ok, 1)
                        count[u] += ok @ copies[v]
                        count[v] += ok.T @ copies[u]
                        for s in range(len(u)):
                            for w in np.flatnonzero(ok[s]):
                                f.join(int(u[s]), int(v[w]))
                r = f.roots()
                fp += rows["fp"][a:b]
                root += [rows["fp"][a + k] for k in r]
                links += count.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64())], ["fp", "root", "links"])

    return members.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "fp").mapInArrow(run, "fp binary, root binary, links long")


def similar(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, row: Column | None = None) -> DataFrame:
    """Per row of ``docs``: row (as in sketch), doc_id, root (tells classes apart even if doc_ids repeat; null without words), class_id
    (smallest doc_id of its class), n_links (rows of at least this similarity), n_copies."""
    drawn = durable(sketch(docs, size, row))
    sets = durable(
        drawn.where("fp IS NOT NULL")
        .groupBy("fp")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    )
    bands = sets.select("fp", F.explode("bands").alias("band"))
    shared = durable(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = bands.join(shared, "band").join(sets.select("fp", "sig"), "fp").select("band", "fp", "sig", "n")
    linked = _linked(buckets.where(F.col("n") <= BLOCK).drop("n"), threshold, tolerance)
    if not shared.where(F.col("n") > BLOCK).isEmpty():
        linked = linked.unionByName(_linked_large(durable(buckets.where(F.col("n") > BLOCK)), threshold, tolerance))
    near = durable(linked.distinct())
    comp = durable(components(near))
    per = comp.groupBy("comp").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = (
        comp.join(per, "comp")
        .join(sets.select("fp", "copies"), comp.id == sets.fp)
        .select("comp", "fp", "copies", "blocks", F.expr("CAST(pmod(xxhash64(fp), blocks) AS INT)").alias("block"))
    )
    wanted = Bitmap.of(comp, F.conv(F.hex(F.substring("id", 1, 3)), 16, 10))
    payload = _sets(docs, wanted, size).dropDuplicates(["fp"])
    dealt = members.join(payload, "fp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "copies", "shingles")
    links = durable(_verified(dealt, threshold, tolerance))
    roots = components(links.where("fp <> root").select(F.col("root").alias("a"), F.col("fp").alias("b")).distinct())
    each = (
        sets.select("fp", "copies", "least")
        .join(roots, sets.fp == roots.id, "left")
        .join(links.groupBy(F.col("fp").alias("of")).agg(F.sum("links").alias("links")), F.col("fp") == F.col("of"), "left")
        .select("fp", "copies", "least", F.coalesce("comp", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    lowest = each.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = each.join(lowest, "root").select("fp", "root", "copies", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return (
        drawn.select("row", "doc_id", "fp", "n_shingles")
        .withColumn("fp", F.coalesce("fp", F.concat(F.lit("row "), F.col("row").cast("string")).cast("binary")))
        .join(classes, "fp", "left")
        .select("row", "doc_id", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))
    )


#: DuckDB SQL for the query's rows: every pair of different sets that share a shingle is compared, without sketches.
ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
 word AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
 runs AS (SELECT doc_id, n, p, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {SIZE - 1} FOLLOWING) AS s FROM word),
 held AS (SELECT DISTINCT doc_id, s FROM runs WHERE p <= greatest(n - {SIZE}, 0)),
 prints AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS fp FROM held GROUP BY doc_id),
 sets AS (SELECT fp, min(n) AS n, count(*) AS copies, min(doc_id) AS least FROM prints GROUP BY fp),
 shingle AS (SELECT least AS id, s FROM sets JOIN held ON held.doc_id = least),
 pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
 close AS (SELECT a, b FROM pairs JOIN sets x ON x.least = a JOIN sets y ON y.least = b WHERE common >= {THRESHOLD} * (x.n + y.n - common) - 1e-6),
 link AS (SELECT a, b FROM close UNION ALL SELECT b, a FROM close),
 met AS (SELECT least AS a, least AS b FROM sets UNION SELECT met.a, link.b FROM met JOIN link ON link.a = met.b),
 class AS (SELECT a AS least, min(b) AS class_id FROM met GROUP BY a),
 linked AS (SELECT link.a AS least, sum(copies) AS links FROM link JOIN sets ON sets.least = link.b GROUP BY link.a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(links, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links, coalesce(copies, 1) AS n_copies
 FROM d LEFT JOIN prints USING (doc_id) LEFT JOIN sets USING (fp) LEFT JOIN class USING (least) LEFT JOIN linked USING (least)"""

"""Language-model scores by context-tree weighting.

A text is the bytes of its lower-cased form and an end mark. Each byte is eight binary decisions; every decision has a tree of
contexts, the last ``DEPTH`` bytes, whose nodes hold Krichevsky-Trofimov estimates. A node's weighted probability is the mean
of its own block probability and the product of its children's, so that all depths are mixed by how well they code the corpus.

The tree is that of the whole training corpus. Block probabilities depend on counts alone, so the corpus is gathered as
counts of (context, byte). Keys hold the latest byte first, so that in sorted order the codes below any context lie together: a
task streams its codes and holds one run of whole three-byte contexts at a time, one bit plane of it at a time. The subtrees' sums give the
two-byte level as a table, that is sent along with the codes below it, and the two levels above it, at most 256 * 255 + 255
nodes, are broadcast. Every (context, byte) that any text holds has a node, with a count of zero if training lacks it, and so an
exact probability. Texts are then scored by look-up: at most ``TOP_GRAMS`` and ``TOP_WORDS`` of the most frequent keys are
broadcast, all others are joined.

Words and contexts are told apart by 64-bit keys. Null texts are empty: an end mark alone. Null ids are held out. Each row is
scored as a text of its own even if its id repeats; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.durable import durable
from factloom.llm.kernels import U64, Words, chunks, signed
from factloom.llm.toxicity import held_out

DEPTH = 6
FOLDS = 10
#: Codes are dealt to tasks by their latest SHARED bytes; a task's runs of whole such contexts have at least RUN codes, the last one less.
SHARED = 3
RUN = 50_000
CHUNK = 500_000
#: A task's counters merge what they gathered at MERGE keys, and hold at most HELD.
MERGE, HELD = 750_000, 2_500_000
#: Rows of a batch that a counter is sent in: what the JVM takes in at once.
SENT = 100_000
TOP_WORDS, TOP_GRAMS = 1 << 18, 1 << 21
SLOTS = 21
END = 0xFF  # no byte of UTF-8
WORD, GRAM, NODE = 0, 1, 2
END_KEY = 0

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words are [^\x20\x09-\x0D]+; byte 0 is one of their letters and is held as 0x20, which no word has.
_LETTERS = np.array([0 if b == 0x20 or 9 <= b <= 0x0D else (0x20 if b == 0 else int(_LOWER[b])) for b in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (``depth`` bytes before, the latest first, then the byte) at each byte and end of each row, and where rows begin in them."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.full(len(data) + n * (depth + 1), END, np.uint8)
    begin = offsets[:-1] + np.arange(n) * (depth + 1) + depth
    row = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) + (row + 1) * (depth + 1) - 1] = _LOWER[data]
    code = np.zeros(len(padded), np.int64)
    for k in range(depth + 1):
        code[depth:] |= padded[depth - k : len(padded) - k].astype(np.int64) << (8 * (depth + 1 - k) if k else 0)
    keep = np.ones(len(padded), bool)
    keep[(begin[:, None] - np.arange(1, depth + 1)[None, :]).ravel()] = False
    return code[keep], offsets[:-1] + np.arange(n)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of keys made one; a stable sort only merges them."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c[order], first) if len(k) else c


class _Counter:
    """Counts by key, kept as sorted runs that are merged when they add up."""

    def __init__(self) -> None:
        self.keys, self.counts, self.pending = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, values: np.ndarray, weight: int) -> None:
        k, c = np.unique(values, return_counts=True)
        self.keys.append(k), self.counts.append(c * weight)
        self.pending += len(k)
        if self.pending > MERGE:
            self.merge()

    def size(self) -> int:
        return len(self.keys[0]) + self.pending

    def merge(self) -> int:
        k, c = _merged(self.keys, self.counts)
        self.keys, self.counts, self.pending = [k], [c], 0
        return len(k)


def counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): training counts of words (and of the end, key 0) and of (context, byte) codes of all texts, as gathered by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes = _Counter(), _Counter()

        def out(kind: int, c: _Counter) -> Iterator[pa.RecordBatch]:
            c.merge()
            keys, counted = c.keys[0], c.counts[0]
            c.__init__()
            for at in range(0, max(len(keys), 1), SENT):
                k, n = keys[at : at + SENT], counted[at : at + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n)], ["kind", "key", "n"])

        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(batch.column("text"), CHUNK):
                part = held[first : first + len(offsets) - 1]
                code, begin = grams(data, offsets, depth)
                row = np.repeat(part, np.diff(np.append(begin, len(code))))
                codes.add(code[~row], 1)
                codes.add(code[row], 0)
                w = Words(data, offsets, _LETTERS)
                learned = np.repeat(~part, np.diff(w.bounds))
                words.add(signed(w.hashes[learned]), 1)
                words.add(np.full(int((~part).sum()), END_KEY, np.int64), 1)
                for kind, c in ((WORD, words), (GRAM, codes)):
                    if c.size() > HELD and c.merge() > HELD // 2:
                        yield from out(kind, c)
        yield from out(WORD, words)
        yield from out(GRAM, codes)

    return _inputs(docs).mapInArrow(run, "kind byte, key long, n long")


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id"), FOLDS).alias("held_out"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_HALF, _ONE = _lgamma(np.arange(1 << 16) + 0.5), _lgamma(np.arange(1 << 16) + 1.0)


def _at(table: np.ndarray, n: np.ndarray, more: float) -> np.ndarray:
    """log gamma of n + more: from the table, and computed for the few counts beyond it."""
    out = table[np.minimum(n, len(table) - 1)]
    far = np.flatnonzero(n >= len(table))
    if len(far):
        out[far] = _lgamma(n[far] + more)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones (whole numbers)."""
    return _at(_HALF, n0, 0.5) + _at(_HALF, n1, 0.5) - 1.1447298858494002 - _at(_ONE, n0 + n1, 1.0)


def _up(node: np.ndarray) -> np.ndarray:
    """The node, or code, with the oldest byte of its context left out."""
    return (node >> 16) << 8 | (node & 0xFF)


def _mixed(n: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of inner nodes: the log of the weighted probability, and the share in it of the node's own estimate."""
    kt = log_kt(n - n1, n1)
    weighted = np.logaddexp(kt, below) - np.log(2)
    return weighted, np.exp(kt - np.log(2) - weighted)


@dataclass
class Plane:
    """One binary decision's subtrees. ``leaf``: node of each code; ``levels``: from the leaves up, (parent below, estimate, own share);
    ``node``, ``n``, ``n1``, ``weighted``: of the nodes at the top."""

    leaf: np.ndarray
    bit: np.ndarray
    levels: list[tuple[np.ndarray | None, np.ndarray, np.ndarray | None]]
    node: np.ndarray
    n: np.ndarray
    n1: np.ndarray
    weighted: np.ndarray


class Subtrees:
    """The trees of a run of (code, n), sorted by code, between leaves at ``depth`` and contexts of ``top`` bytes, all whole."""

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int, top: int) -> None:
        self.codes, self.counts, self.parents = [code], [n], []
        for _ in range(depth - top):  # sorted once a level; every bit plane's nodes are runs of it
            code, up = np.unique(_up(code), return_inverse=True)
            n = np.bincount(up, n, len(code)).astype(np.int64)
            self.codes.append(code), self.counts.append(n), self.parents.append(up)

    def planes(self) -> Iterator[Plane]:
        for j in range(8):
            levels, leaf, leaf_bit = [], None, None
            first = weighted = None
            for d, (code, n) in enumerate(zip(self.codes, self.counts, strict=True)):
                byte = code & 0xFF
                bit = (byte >> (7 - j)) & 1
                node = code >> 8 << 8 | (1 << j) | (byte >> (8 - j))
                new = np.concatenate([[True], node[1:] != node[:-1]])
                place, begin = np.cumsum(new) - 1, np.flatnonzero(new)
                total, ones = np.add.reduceat(n, begin), np.add.reduceat(n * bit, begin)
                if d:
                    parent = place[self.parents[d - 1][first]]
                    weighted, own = _mixed(total, ones, np.bincount(parent, weighted, len(begin)))
                else:  # a leaf is all its own estimate
                    parent, own, weighted = None, None, log_kt(total - ones, ones)
                    leaf, leaf_bit = place, bit
                levels.append((parent, (ones + 0.5) / (total + 1), own))
                first, at_top = begin, node[begin]
            yield Plane(leaf, leaf_bit, levels, at_top, total, ones, weighted)

    def log10(self, above: list) -> np.ndarray:
        """log10 P(byte | context) of every code. ``above``: for each level over the top, a function from nodes to estimates and own shares."""
        out = np.zeros(len(self.codes[0]))
        for plane in self.planes():
            p = plane.levels[0][1]
            at = np.arange(len(p))
            for parent, estimate, own in plane.levels[1:]:
                at = parent[at]
                p = own[at] * estimate[at] + (1 - own[at]) * p
            node = plane.node
            for level in above:
                node = _up(node)
                estimate, own = level(node)
                p = own[at] * estimate[at] + (1 - own[at]) * p
            out += np.where(plane.bit == 1, np.log10(p)[plane.leaf], np.log10(1 - p)[plane.leaf])
        return out


class Runs:
    """Cuts batches that are sorted by key into tables of whole groups of ``key >> shift``: of at least ``least`` rows, the last may be shorter."""

    def __init__(self, shift: int, least: int) -> None:
        self.shift, self.least, self.held, self.size, self.need = shift, least, [], 0, least

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        self.held.append(batch)
        self.size += batch.num_rows
        if self.size < self.need:
            return
        t = pa.Table.from_batches(self.held)
        group = t.column("key").to_numpy() >> self.shift
        cut = int(np.searchsorted(group, group[-1]))
        self.held, self.size = t.slice(cut).to_batches(), self.size - cut
        self.need = max(self.least, 2 * self.size)
        if cut:
            yield t.slice(0, cut)

    def end(self) -> Iterator[pa.Table]:
        if self.size:
            yield pa.Table.from_batches(self.held)

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            yield from self.feed(batch)
        yield from self.end()


def _parts(counted: DataFrame, depth: int, least: int) -> DataFrame:
    """(kind, key, n, n1, w): ``counts`` put together, and the sums of subtrees that NODE rows hold for the level above them."""
    top = min(depth, SHARED)
    shift = 8 * (depth - top + 1)
    place = F.when(F.col("kind") == GRAM, F.shiftright("key", shift)).otherwise(F.pmod("key", F.lit(1 << 24)))
    whole = counted.withColumn("place", place).repartition("place").groupBy("place", "kind", "key").agg(F.sum("n").alias("n"))

    def sums(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for plane in Subtrees(t.column("key").to_numpy(), t.column("n").to_numpy(), depth, top).planes():
            node, at = np.unique(_up(plane.node), return_inverse=True)
            n, n1, w = (np.bincount(at, x, len(node)) for x in (plane.n, plane.n1, plane.weighted))
            cols = (np.full(len(node), NODE, np.int8), node, n.astype(np.int64), n1.astype(np.int64), w)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["kind", "key", "n", "n1", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(shift, least)
        for batch in batches:
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "key", "n")), none, none.cast(pa.float64())], ["kind", "key", "n", "n1", "w"])
            codes = batch.filter(pc.equal(batch.column("kind"), GRAM))
            if codes.num_rows:
                for t in runs.feed(codes):
                    yield from sums(t)
        for t in runs.end():
            yield from sums(t)

    return whole.sortWithinPartitions("kind", "key").select("kind", "key", "n").mapInArrow(run, "kind byte, key long, n long, n1 long, w double")


def _estimated(nodes: DataFrame) -> DataFrame:
    """(node, n, n1, w, p, own) of inner nodes (node, n, n1, and w, the sum of their children)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, n1 = b.column("n").to_numpy(), b.column("n1").to_numpy()
            weighted, own = _mixed(n, n1, b.column("w").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "n", "n1")), *map(pa.array, (weighted, (n1 + 0.5) / (n + 1), own))], ["node", "n", "n1", "w", "p", "own"])

    return nodes.mapInArrow(run, "node long, n long, n1 long, w double, p double, own double")


def _summed(nodes: DataFrame, node: Column) -> DataFrame:
    return nodes.groupBy(node.alias("node")).agg(*(F.sum(c).alias(c) for c in ("n", "n1", "w")))


def _dense(nodes: pd.DataFrame, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Estimates and own shares by node at the contexts of levels - 1, ..., 0 bytes, from the sums at the first; one half where there is none."""
    node, n, n1, below = (nodes[c].to_numpy() for c in ("node", "n", "n1", "w"))
    out = []
    for d in range(levels - 1, -1, -1):
        weighted, own = _mixed(n, n1, below)
        dense = np.full((2, 1 << (8 * (d + 1))), 0.5)
        dense[0, node], dense[1, node] = (n1 + 0.5) / (n + 1), own
        out.append((dense[0], dense[1]))
        node, at = np.unique(node & 0xFF, return_inverse=True)
        n, n1 = (np.bincount(at, x, len(node)).astype(np.int64) for x in (n, n1))
        below = np.bincount(at, weighted, len(node))
    return out


def probabilities(parts: DataFrame, depth: int = DEPTH, least: int = RUN) -> DataFrame:
    """(key, n, value): log10 P(byte | context) of every code in ``parts`` (of ``_parts``)."""
    top = min(depth, SHARED)
    shift = 8 * (depth - top + 1)
    codes = parts.where(F.col("kind") == GRAM).select("key", "n", *(F.lit(None).cast(t).alias(c) for c, t in (("node", "long"), ("p", "double"), ("own", "double"))))
    sums = _summed(parts.where(F.col("kind") == NODE), F.col("key"))
    if top == SHARED:
        middle = durable(_estimated(sums))
        up = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(0xFF)))
        sums = _summed(middle, up)
        shift += 8  # nodes come before the codes of their two bytes, in one run
        first = F.shiftleft(F.shiftright("node", 8), shift)
        codes = codes.unionByName(middle.select(first.alias("key"), F.lit(0).cast("long").alias("n"), "node", "p", "own"))
    held = parts.sparkSession.sparkContext.broadcast(_dense(sums.toPandas(), min(top, SHARED - 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = [lambda node, t=t: (t[0][node], t[1][node]) for t in held.value]
        known, last = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)], -1

        def find(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(known[0], node)
            return known[1][at], known[2][at]

        for t in Runs(shift - 8 if top == SHARED else shift, least).of(batches):
            code, sent = t.filter(pc.is_null(t.column("node"))), t.filter(pc.is_valid(t.column("node")))
            if sent.num_rows:  # nodes of the pair of bytes met last may be needed still
                fresh = [sent.column(c).to_numpy() for c in ("node", "p", "own")]
                keep = known[0] >> 8 == last
                known = [np.concatenate([k[keep], f]) for k, f in zip(known, fresh, strict=True)]
                order = np.argsort(known[0])
                known = [k[order] for k in known]
                last = known[0][-1] >> 8
            if code.num_rows:
                key, n = (code.column(c).to_numpy() for c in ("key", "n"))
                value = Subtrees(key, n, depth, top).log10([find, *above] if top == SHARED else above)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(value)], ["key", "n", "value"])

    dealt = codes.repartition(F.shiftright("key", shift)).sortWithinPartitions("key", F.col("node").isNull())
    return dealt.mapInArrow(score, "key long, n long, value double")


class Lookup:
    """Keys and values in the order of their slots, and where each slot begins: no more memory than what was sent and 8 MB."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        count = np.bincount(self.slot(keys), minlength=1 << SLOTS)
        self.keys, self.values, self.most = keys, values, int(count.max())
        self.begin = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - SLOTS)).astype(np.int64)

    @classmethod
    def ordered(cls, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(cls.slot(keys), kind="stable")
        return keys[order], values[order]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        found, out = np.zeros(len(keys), bool), np.zeros(len(keys))
        slot = self.slot(keys)
        at, end = self.begin[slot], self.begin[slot + 1]
        left = np.flatnonzero(at < end)
        for k in range(self.most):
            place = at[left] + k
            hit = self.keys[place] == keys[left]
            found[left[hit]], out[left[hit]] = True, self.values[place[hit]]
            left = left[~hit & (place + 1 < end[left])]
            if not len(left):
                break
        return found, out


_lookups: dict[str, tuple[Lookup, Lookup]] = {}


def _rest(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) and how often."""
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], keys[new], np.diff(np.append(new, len(row)))


def frequent(table: DataFrame, most: int) -> DataFrame:
    """(key, value) of the most frequent keys: those above the least count that no more than ``most`` keys reach. The bound comes from how many
    keys have each count, so that no task sorts keys."""
    sizes = table.groupBy("n").agg(F.count("*").alias("keys")).orderBy(F.desc("n")).limit(most).toPandas()
    fit = sizes["n"].to_numpy()[np.cumsum(sizes["keys"].to_numpy()) <= most]
    least = int(fit[-1]) if len(fit) else None
    return table.where(F.col("n") >= least if least is not None else F.lit(False)).select("key", "value")


def score(docs: DataFrame, depth: int = DEPTH, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS, least: int = RUN) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    counted = durable(_parts(counts(docs, depth), depth, least))
    words = counted.where(F.col("kind") == WORD).select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = float(np.log10(total + 0.1 * (distinct + 1)))
    words = words.withColumn("value", F.log10(F.col("n") + 0.1) - below)
    codes = durable(probabilities(counted, depth, least))
    top = [frequent(t, k).toArrow() for t, k in ((words, top_words), (codes, top_grams))]
    held = docs.sparkSession.sparkContext.broadcast([Lookup.ordered(t.column("key").to_numpy(), t.column("value").to_numpy()) for t in top])
    model = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _lookups:  # once per Python worker
            _lookups.clear()
            _lookups[model] = tuple(Lookup(k, v) for k, v in held.value)
        lookup = _lookups[model]
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in chunks(batch.column("text"), CHUNK):
                n = len(offsets) - 1
                code, begin = grams(data, offsets, depth)
                found, value = lookup[GRAM].get(code)
                score = np.add.reduceat(value, begin)
                gram_row, gram_key, gram_n = _rest(np.searchsorted(begin, np.flatnonzero(~found), "right") - 1, code[~found])
                w = Words(data, offsets, _LETTERS)
                key = np.insert(signed(w.hashes), w.bounds[1:], END_KEY)
                row = np.repeat(np.arange(n), np.diff(w.bounds) + 1)
                found, value = lookup[WORD].get(key)
                at = w.bounds[:-1] + np.arange(n)
                base, known = np.add.reduceat(value, at), np.add.reduceat(found.astype(np.int64), at)
                word_row, word_key, word_n = _rest(row[~found], key[~found])
                rows = batch.column("row").to_numpy()[first : first + n]
                more = len(word_row) + len(gram_row)
                tail = np.concatenate([word_row, gram_row])
                head = lambda x, kind: pa.array(np.concatenate([x, np.zeros(more, x.dtype)]), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, rows[tail]])),
                        pa.concat_arrays([ids.slice(first, n), pa.nulls(more, pa.int64())]),
                        pa.concat_arrays([batch.column("held_out").slice(first, n), pa.nulls(more, pa.bool_())]),
                        head(np.diff(offsets), pa.int64()),
                        head(np.diff(w.bounds) + 1, pa.int64()),
                        head(known, pa.int64()),
                        head(base, pa.float64()),
                        head(score, pa.float64()),
                        pa.array(np.concatenate([np.full(n, -1), np.full(len(word_row), WORD), np.full(len(gram_row), GRAM)]), pa.int8()),
                        pa.array(np.concatenate([rows, word_key, gram_key])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), word_n, gram_n])),
                    ],
                    ["row", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "score", "kind", "key", "n"],
                )

    schema = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double, kind byte, key long, n long"
    table = words.select(F.lit(WORD).cast("byte").alias("kind"), "key", "value").unionByName(codes.select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value"))
    joined = _inputs(docs).mapInArrow(run, schema).join(table, ["kind", "key"], "left")
    unseen = F.lit(-1.0 - below)
    is_word, is_gram = F.col("kind") == WORD, F.col("kind") == GRAM
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n_tokens").alias("n_tokens"),
            (F.sum("n_known") + F.sum(F.when(is_word & F.col("value").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.sum("base") + F.sum(F.when(is_word, F.col("n") * F.coalesce("value", unseen)).otherwise(0.0))).alias("base_score"),
            (F.sum("score") + F.sum(F.when(is_gram, F.col("n") * F.col("value")).otherwise(0.0))).alias("score"),
            F.sum("n_bytes").alias("n_bytes"),
        )
        .withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1))
        .drop("row")
    )

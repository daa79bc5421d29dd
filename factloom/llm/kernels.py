"""Vectorised byte and word kernels that run inside Arrow tasks.

A chunk is a few whole documents as one byte array with offsets; every kernel works on all of a
chunk's documents at once, so that no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 2_000_000
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def byte_table(is_word) -> np.ndarray:
    """256 entries: the byte with A-Z lower-cased where ``is_word`` holds of that, else 0."""
    low = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([b if is_word(b) else 0 for b in low], np.uint8)


#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of at most ``limit`` bytes, or of one longer row; null is empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:  # what a null row covers is undefined
        gone = np.asarray(texts.is_null())
        if (np.diff(at)[gone] > 0).any():
            yield from chunks(texts.fill_null(b"" if pa.types.is_binary(texts.type) else ""), limit)
            return
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a chunk: ``hashes``, ``starts`` and ``ends`` (bytes), ``bounds`` (first word of each row, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM) -> None:
        low = table[data]
        on = low != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        off = np.ones(len(data) + 2, bool)
        off[1:-1] = ~on
        self.low = low
        self.starts = np.flatnonzero(on & (off[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(on & (off[2:] | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        size = self.ends - self.starts
        if len(size):
            first = np.cumsum(size) - size
            letters = low[on].astype(U64)
            at = np.arange(len(letters)) - np.repeat(first, size)
            power = _powers(int(size.max()), _BASE)
            self.hashes = mix(np.add.reduceat(letters * power[at], first) + size.astype(U64))
        else:
            self.hashes = np.zeros(0, U64)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, but not none, one of all."""
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.zeros(n, U64)
    for k, p in enumerate(_powers(size + 1, U64(0xD6E8FEB86659FD93))[1:]):
        out += hashes[k : k + n] * p
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Bitmap:
    """A set of hashes as 2**24 bits: its size is fixed, false positives are told apart by the join that follows."""

    BITS = 24

    def __init__(self, packed: np.ndarray) -> None:
        self.packed = packed

    @classmethod
    def of(cls, rows: DataFrame, slot: Column) -> Bitmap:
        """The bitmap of a column of slots, put together by Spark: at most 512 parts of 4 kB reach the driver, however many rows there are."""
        place = slot.cast("long") + 1  # Spark numbers the buckets of 32,768 places that begin at 1 from 1
        parts = (
            rows.select(place.alias("p"))
            .where("p IS NOT NULL")
            .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        )
        packed = np.zeros((1 << cls.BITS) // 8, np.uint8)
        for r in parts.collect():
            at = (r["bucket"] - 1) * 4096
            packed[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
        return cls(packed)

    @classmethod
    def slots(cls, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - cls.BITS)).astype(np.int64)

    def flags(self) -> np.ndarray:
        return np.unpackbits(self.packed, bitorder="little").view(bool)


def signed_slot_sql(column: str) -> str:
    """Bitmap.slots of a signed 64-bit column, in SQL."""
    return f"shiftrightunsigned({column}, {64 - Bitmap.BITS})"


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``: each holds all rows of its keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        first = [batch.column(k)[0] for k in keys]
        if first == last:  # one group so far: no border that is known to be one
            if len(held) > 1 and [held[0].column(k)[0] for k in keys] != first:
                whole = pa.Table.from_batches(held[:-1])
                cut = _border(whole, keys, last)
                if cut:
                    yield whole.slice(0, cut)
                    held = [*whole.slice(cut).to_batches(), batch]
            continue
        whole = pa.Table.from_batches(held)
        cut = _border(whole, keys, last)
        yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _border(table: pa.Table, keys: list[str], last: list) -> int:
    """Where the run of the key ``last`` at the end of ``table`` begins."""
    lo, hi = 0, table.num_rows
    while lo < hi:  # sorted: rows of the last key are a suffix
        mid = (lo + hi) // 2
        if [table.column(k)[mid] for k in keys] == last:
            hi = mid
        else:
            lo = mid + 1
    return lo

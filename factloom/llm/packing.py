"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are tokenised and closed by ``end_id``; only those longer than ``capacity`` are cut, into full pieces that are
sequences of their own and a last piece that may be shorter. Shorter pieces are packed best-fit decreasing within
partitions. Bins with at most ``slack`` free tokens are emitted; the others go, as items of their fill, to an
``fan_in``-th of the partitions, but at most ``per_task`` bins to each, for another best-fit round, until one round fits
one task or no bin is left open. Where more than one task's bins are open and a round has closed or joined fewer than
``GAIN`` of them, they are emitted as they are: hardly two of them fit together. Each round is written to the shared folder, so a lost executor repeats a round at most.

Null and empty texts are the end token alone; each row is a document of its own even if its doc_id repeats; ties
take the item met first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.durable import durable

CAPACITY = 2048
SLACK = 8
PER_TASK = 20_000
FAN_IN = 8
GAIN = 0.05
PIECE = "struct<row:long,doc_id:long,piece:int,start:long,length:long,ids_crc32:long>"
BIN = f"done boolean, fill int, seq long, pieces array<{PIECE}>"


class CachedTokenizer:
    """Token ids as little-endian unsigned 32-bit bytes. Words are looked up in a cache; what the cache cannot split
    the way the tokenizer does (characters beyond U+024F, special tokens) goes through the tokenizer as a whole text."""

    LIMIT = 1_500_000
    #: The tokenizer's own pattern, for characters up to U+024F that are lower-cased.
    SPLIT = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]"
        r"|[^\x09-\x0d\x20\x85\xa0a-z0-9ªµºß-öø-ɏ²³¹¼-¾]+"
    )
    PLAIN = re.compile(r"[\x00-įĲ-ɏ]*")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        fill = iter(range(256, 512))
        spelled = {b: chr(b) if b in printable else chr(next(fill)) for b in range(256)}
        table = [spelled[b] for b in range(256)]

        class Cache(dict):
            def __missing__(cache, word: str) -> bytes:  # noqa: N805
                if len(cache) >= self.LIMIT:
                    cache.clear()
                text = "".join([table[b] for b in word.encode()])
                cache[word] = ids = np.array([t.id for t in model.tokenize(text)], "<u4").tobytes()
                return ids

        self.cache = Cache()

    def ids(self, text: str) -> bytes:
        if "<|" in text or not self.PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, self.SPLIT.findall(text.lower())))


_loaded: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One per Python worker, kept between its tasks."""
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32 of every piece of every row of ``docs``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            out: list[tuple] = []
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = tok.ids(text.as_py() or "") + end
                view = memoryview(ids)
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    out.append((row, doc, p, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = rooms >> s
        if fit:
            room = s + ((fit & -fit).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins


def _round(bins: DataFrame, number: int, capacity: int, slack: int, last: bool) -> DataFrame:
    """One best-fit round within the partitions of ``bins`` (fill, pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (number << 54) | (TaskContext.get().partitionId() << 30)
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        fill = t.column("fill").to_numpy().astype(np.int64)
        lists = t.column("pieces").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        ends = lists.offsets.to_numpy()
        made = best_fit(fill, capacity)
        order = np.concatenate([np.arange(ends[i], ends[i + 1]) for b in made for i in b])
        total = np.array([int(fill[b].sum()) for b in made])
        count = np.array([sum(int(ends[i + 1] - ends[i]) for i in b) for b in made])
        at = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((total >= capacity - slack) | last),
                pa.array(total, pa.int32()),
                pa.array(base + np.arange(len(made)), pa.int64()),
                pa.ListArray.from_arrays(at, lists.values.take(pa.array(order))),
            ],
            ["done", "fill", "seq", "pieces"],
        )

    return bins.mapInArrow(run, BIN)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, slack: int = SLACK, end_id: int = 0, per_task: int = PER_TASK) -> DataFrame:
    """Per piece of ``docs``: row, doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence."""
    cut = durable(pieces(docs, path, capacity, end_id))
    full = cut.where(F.col("length") == capacity).select(
        *cut.columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    part = cut.where(F.col("length") < capacity)
    before = part.count()
    tasks = max(1, -(-before // per_task))
    bins = part.select(F.col("length").cast("int").alias("fill"), F.array(F.struct(*cut.columns)).alias("pieces"))
    bins = bins.repartition(tasks, F.xxhash64(F.col("pieces")[0]["row"]))
    closed, number = [], 1
    while True:
        made = durable(_round(bins, number, capacity, slack, last=tasks == 1))
        still = made.where("NOT done").count()
        if still > per_task and still > (1 - GAIN) * before:
            closed.append(made)
            break
        closed.append(made.where("done"))
        if not still:
            break
        tasks, number, before = max(-(-tasks // FAN_IN), -(-still // per_task)), number + 1, still
        bins = made.where("NOT done").select("fill", "pieces").repartition(tasks, F.xxhash64(F.col("pieces")[0]["row"]))
    done = closed[0]
    for more in closed[1:]:
        done = done.unionByName(more)
    earlier = F.aggregate(F.slice("pieces", 1, F.col("at")), F.lit(0).cast("long"), lambda n, p: n + p.length)
    placed = done.select("seq", "pieces", F.posexplode("pieces").alias("at", "p")).select("p.*", F.col("seq").alias("sequence_id"), earlier.alias("offset"))
    return full.unionByName(placed)

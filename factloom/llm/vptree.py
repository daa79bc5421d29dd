"""Nearest neighbours by vantage-point trees, one per shard.

Largest inner product becomes smallest Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2), with M the largest norm. Vectors
are dealt to the nearest of at most ``PIVOTS`` pivots, drawn by hash, and a pivot's cell to shards of about ``SHARD`` vectors. A task
holds one shard: it builds the shard's tree, then streams queries through it in blocks. A query first searches its own cell, then
those cells that the triangle inequality does not put beyond its k-th distance so far; in a tree, subtrees are left out by the same
test. ``factor`` multiplies that bound: a factor of one gives exact search, greater ones prune more.

Scores are sums of products in double precision over the original vectors; ties go to the smaller id. Vectors that are
null, zero or hold null or non-finite components take no part, nor do null ids; vectors of different lengths are not
compared. Each row is a vector of its own even if its id repeats; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.durable import durable

SHARD = 8192
PIVOTS = 1024
QUERIES = 2048
LEAF = 128
FACTOR = 1.1


def _flat(x: np.ndarray, reach2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(reach2 - np.einsum("ij,ij->i", x, x), 0.0))])


class VantageTree:
    """Nodes split at the median distance from a vantage point; identical points end in one leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        norm2 = np.einsum("ij,ij->i", x, x)
        self.reach2 = float(norm2.max(initial=0.0))
        self.x = x
        self.flat = np.column_stack([x, np.sqrt(np.maximum(self.reach2 - norm2, 0.0))])
        self.root = self._node(np.arange(len(x)), leaf)

    def _node(self, at: np.ndarray, leaf: int):
        if len(at) <= leaf:
            return at
        p = self.flat[at]
        far = p[((p - p[0]) ** 2).sum(axis=1).argmax()]  # a point at the edge parts better
        d = np.sqrt(((p - far) ** 2).sum(axis=1))
        mid = float(np.median(d))
        near = d <= mid
        if near.all():
            near = d < mid
        if not near.any() or near.all():
            return at
        return far, (float(d[near].min()), float(d[near].max())), (float(d[~near].min()), float(d[~near].max())), self._node(at[near], leaf), self._node(at[~near], leaf)

    def search(self, q: np.ndarray, own: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int, factor: float, floor: np.ndarray):
        """(query, point, score) of the k best points of at least the score ``floor`` for every query; ``own`` is the row that each query leaves out."""
        best = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), -1)
        order = np.full((len(q), k), np.iinfo(np.int64).max)
        q2 = np.einsum("ij,ij->i", q, q)
        flat = np.column_stack([q, np.zeros(len(q))])
        slack = 1e-9 * (1 + q2 + self.reach2)

        def visit(node, live: np.ndarray) -> None:
            if not len(live):
                return
            if isinstance(node, np.ndarray):
                # einsum adds in one order for every pair, so equal vectors have equal scores
                score = np.einsum("ij,kj->ik", q[live], self.x[node], optimize=False)
                hopeful = (score >= np.maximum(best[live, -1], floor[live])[:, None]) & (own[live][:, None] != row[node][None, :])
                some = np.flatnonzero(hopeful.any(axis=1))
                if not len(some):
                    return
                score, a = np.where(hopeful[some], score[some], -np.inf), live[some]
                c = int(hopeful.sum(axis=1).max())
                cols = np.argpartition(-score, c - 1, axis=1)[:, :c] if c < len(node) else np.broadcast_to(np.arange(len(node)), score.shape)
                score = np.take_along_axis(score, cols, 1)
                s = np.hstack([best[a], score])
                w = np.hstack([who[a], np.where(score > -np.inf, node[cols], -1)])
                o = np.hstack([order[a], ids[node[cols]]])
                top = np.lexsort((o, -s), axis=-1)[:, :k]
                best[a], who[a], order[a] = (np.take_along_axis(z, top, 1) for z in (s, w, o))
                return
            point, inner, outer, near, far = node
            d = np.sqrt(np.maximum(((flat[live] - point) ** 2).sum(axis=1), 0.0))
            first = d <= (inner[1] + outer[0]) / 2

            def within(of: np.ndarray, dist: np.ndarray, ring: tuple[float, float]) -> np.ndarray:
                bound = np.maximum(np.maximum(ring[0] - dist, dist - ring[1]), 0.0) * factor
                worst = q2[of] + self.reach2 - 2 * np.maximum(best[of, -1], floor[of])
                return bound**2 <= worst + slack[of]

            for part, here, ring_here, there, ring_there in ((first, near, inner, far, outer), (~first, far, outer, near, inner)):
                of, dist = live[part], d[part]
                keep = within(of, dist, ring_here)
                visit(here, of[keep])
                keep = within(of, dist, ring_there)
                visit(there, of[keep])

        visit(self.root, np.arange(len(q)))
        a, b = np.nonzero(who >= 0)
        return a, who[a, b], best[a, b]


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    base = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return base.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _segments(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows of equal keys."""
    k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
    cut = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0), [True]]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield tuple(k[:, a].tolist()), batch.slice(a, b - a)


def _searched(points: DataFrame, queries: DataFrame, k: int, factor: float) -> DataFrame:
    """(row, query_id, vec_id, score): of each query (with floor) its best in each shard (dim, cell, part) that it is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            for (*key, asks), some in _segments(batch, ["dim", "cell", "part", "asks"]):
                if key != shard:
                    shard, held, tree = key, [], None
                x, rows, ids = _vectors(some.column("v"), key[0]), some.column("row").to_numpy(), some.column("id").to_numpy()
                if not asks:
                    held.append((x, rows, ids))
                    continue
                if tree is None and held:
                    points, point_rows, point_ids = (np.concatenate(c) for c in zip(*held, strict=True))
                    tree, held = VantageTree(points), []
                for at in range(0, len(x) if tree else 0, QUERIES):
                    part = slice(at, at + QUERIES)
                    floor = some.column("floor").to_numpy()[part]
                    a, b, score = tree.search(x[part], rows[part], point_rows, point_ids, k, factor, floor)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows[part][a], ids[part][a], point_ids[b], score)], ["row", "query_id", "vec_id", "score"])

    columns = ["dim", "cell", "part", "asks", "row", "id", "v", "floor"]
    sent = points.withColumn("asks", F.lit(0)).withColumn("floor", F.lit(0.0)).select(columns).unionByName(queries.withColumn("asks", F.lit(1)).select(columns))
    keys = ["dim", "cell", "part"]
    return sent.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(run, "row long, query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each row for which ``is_query(id column)`` holds."""
    base = durable(_usable(vectors, id_col, vec_col).withColumn("dim", F.size("v")).withColumn("query", F.coalesce(is_query(F.col("id")), F.lit(False))))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, reach2 = base.agg(F.count("*"), F.coalesce(F.max(norm2), F.lit(0.0))).first()
    wanted = min(PIVOTS, -(-n // SHARD))
    pivots: dict[int, np.ndarray] = {}
    for r in base.select("dim", "v", F.xxhash64("id", "v", "row").alias("h")).orderBy("h").limit(wanted).collect():
        pivots.setdefault(r["dim"], []).append(r["v"])
    held = base.sparkSession.sparkContext.broadcast({d: _flat(np.unique(np.array(p), axis=0), reach2) for d, p in pivots.items()})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.take(pa.array(np.argsort(batch.column("dim").to_numpy(), kind="stable")))
            for (dim,), some in _segments(order, ["dim"]) if batch.num_rows else ():
                x = _flat(_vectors(some.column("v"), dim), reach2)
                p = held.value.get(dim, np.zeros((1, dim + 1)))
                d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T, 0.0))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("row", "id", "v", "dim", "query")), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["row", "id", "v", "dim", "query", "cell", "d"]
                )

    placed = durable(base.select("row", "id", "v", "dim", "query").mapInArrow(dealt, "row long, id long, v array<double>, dim int, query boolean, cell int, d double"))
    # one row a cell, at most PIVOTS and one for each length without a pivot
    cells = durable(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"), F.min("d").alias("inner"), F.max("d").alias("outer")))
    rings: dict[int, list] = {}
    for r in cells.where(F.col("dim").isin(list(pivots))).collect():
        rings.setdefault(r["dim"], []).append((r["cell"], r["inner"], r["outer"]))
    around = base.sparkSession.sparkContext.broadcast({d: np.array(sorted(r)) for d, r in rings.items()})
    points = placed.join(F.broadcast(cells.select("dim", "cell", "parts")), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    queries = placed.where("query")
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    sized = F.broadcast(cells.select("dim", "cell", "parts"))
    first = queries.withColumn("floor", F.lit(float("-inf"))).join(sized, ["dim", "cell"]).select("dim", "cell", every_part, "row", "id", "v", "floor")
    near = durable(_best(_searched(points, first, k, factor), k))
    worst = near.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    again = queries.join(worst, "row", "left").select("row", "id", "v", "dim", "cell", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other cells that a query must look into."""
        for batch in batches:
            order = batch.take(pa.array(np.argsort(batch.column("dim").to_numpy(), kind="stable")))
            for (dim,), some in _segments(order, ["dim"]) if batch.num_rows else ():
                if dim not in around.value:
                    continue
                x, own, floor = _vectors(some.column("v"), dim), some.column("cell").to_numpy(), some.column("floor").to_numpy()
                q2 = (x * x).sum(axis=1)
                p = held.value[dim]
                cell, inner, outer = around.value[dim].T
                cell = cell.astype(np.int64)
                d = np.sqrt(np.maximum(q2[:, None] + (p * p).sum(axis=1) - 2 * x @ p[:, :-1].T, 0.0))[:, cell]  # a query's last coordinate is zero
                bound = np.maximum(np.maximum(inner - d, d - outer), 0.0) * factor
                with np.errstate(invalid="ignore"):
                    look = (bound**2 <= (q2 + reach2 - 2 * floor + 1e-9 * (1 + q2 + reach2))[:, None]) & (own[:, None] != cell)
                at, to = np.nonzero(look)
                sent = some.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(sent.column(c) for c in ("row", "id", "v", "dim", "floor")), pa.array(cell[to], pa.int32())], ["row", "id", "v", "dim", "floor", "cell"])

    more = again.mapInArrow(others, "row long, id long, v array<double>, dim int, floor double, cell int").join(sized, ["dim", "cell"])
    far = _searched(points, more.select("dim", "cell", every_part, "row", "id", "v", "floor"), k, factor)
    columns = ["row", "query_id", "vec_id", "score"]
    return _best(near.select(columns).unionByName(far.select(columns)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

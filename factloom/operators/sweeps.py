"""What depends on order: one pass over each group's sorted rows in a task that holds what is open, never the group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least width and depth of a cell, gap between blocks, edge of a plate, gap between plates.
CELL_WIDTH, CELL_DEPTH, BLOCK_GAP, EDGE, PLATE_GAP = 0.62 * 2.6, 0.62 * 2.6, 1.0, 3.4, 7.0


def nesting(spans: DataFrame) -> DataFrame:
    """(path, id, parent, depth, crosses) of ``spans`` (path, id, start, end): the nearest span of the path that holds each, how many are open around it, and
    whether it begins inside its neighbour and ends behind it.

    Spans come by start, the longer first, then by id; of equal spans the first holds the others. The parent is the last before that holds the span. Where
    nothing crosses the spans are nested, and the chain of parents is all that hold a span. A task keeps the spans that are open, so no two of a
    path are paired. Spans without a path or id, or that end before they begin, are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, stack = None, []
        for pdf in batches:
            parents, depths, crosses = [], [], []
            for p, i, start, end in zip(pdf["path"], pdf["id"], pdf["start"], pdf["end"], strict=True):
                if p != path:
                    path, stack = p, []
                over = False
                while stack and stack[-1][1] < end:
                    over |= stack.pop()[1] > start
                parents.append(stack[-1][0] if stack else None)
                depths.append(len(stack))
                crosses.append(over)
                stack.append((i, end))
            yield pdf[["path", "id"]].assign(parent=pd.Series(parents, index=pdf.index, dtype=object), depth=depths, crosses=crosses)

    kind = lambda c: spans.schema[c].dataType.simpleString()
    rows = spans.where("path IS NOT NULL AND id IS NOT NULL AND start <= `end`").select("path", "id", "start", "end")
    dealt = rows.repartition("path").sortWithinPartitions("path", "start", F.desc("end"), "id")
    return dealt.mapInPandas(run, f"path {kind('path')}, id {kind('id')}, parent {kind('id')}, depth long, crosses boolean")


def footprints(plates: DataFrame) -> DataFrame:
    """``plates`` (city, plate, blocks, block_w, block_d: the widest and the deepest) with cols, w and d: blocks stand in a square grid of equal cells."""
    blocks = F.greatest("blocks", F.lit(1))
    cols = F.ceil(F.sqrt(blocks))
    width = F.greatest(F.lit(CELL_WIDTH), F.coalesce("block_w", F.lit(0.0))) + BLOCK_GAP
    depth = F.greatest(F.lit(CELL_DEPTH), F.coalesce("block_d", F.lit(0.0))) + BLOCK_GAP
    return plates.withColumns({"cols": cols, "w": cols * width + EDGE, "d": F.ceil(blocks / cols) * depth + EDGE})


def shelves(plates: DataFrame) -> DataFrame:
    """(city, plate, shelf, x, z): plates (city, plate, w, d) side by side in their order; one that would pass the shelf's end begins the next shelf.

    A shelf is as wide as the widest plate of its city times the root of their number, rounded up; it is as deep as its deepest plate. A task holds one cursor.
    """
    widths = plates.groupBy("city").agg((F.max("w") * F.ceil(F.sqrt(F.count("*")))).alias("room"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        city, x, z, deep, shelf = None, 0.0, 0.0, 0.0, 0
        for pdf in batches:
            out = []
            for c, w, d, room in zip(pdf["city"], pdf["w"], pdf["d"], pdf["room"], strict=True):
                if c != city:
                    city, x, z, deep, shelf = c, 0.0, 0.0, 0.0, 0
                elif x + w > room:
                    x, z, deep, shelf = 0.0, z + deep + PLATE_GAP, 0.0, shelf + 1
                out.append((shelf, x, z))
                x, deep = x + w + PLATE_GAP, max(deep, d)
            yield pdf[["city", "plate"]].assign(**dict(zip(("shelf", "x", "z"), zip(*out, strict=True), strict=True))) if out else pdf[["city", "plate"]].assign(shelf=0, x=0.0, z=0.0)

    kind = lambda c: plates.schema[c].dataType.simpleString()
    rows = plates.where("city IS NOT NULL").select("city", "plate", F.col("w").cast("double"), F.col("d").cast("double")).join(widths, "city")
    dealt = rows.repartition("city").sortWithinPartitions("city", "plate")
    return dealt.mapInPandas(run, f"city {kind('city')}, plate {kind('plate')}, shelf long, x double, z double")

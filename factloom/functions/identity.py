"""Identities: digests and span-bearing ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """SHA-256, in lower-case hex, of the parts joined by NUL; nulls are spelled out, so that no two tuples meet."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("<null>")) for p in parts]
    return F.sha2(F.concat_ws("\u0000", *cols), 256)


def symbol_id(path: str, start: str, end: str) -> Column:
    return edge_id("symbol", path, start, end)


def edge_id(kind: str, path: str, start: str, end: str) -> Column:
    return F.concat_ws(":", F.lit(kind), F.col(path), F.col(start).cast("string"), F.col(end).cast("string"))


def anchor(kind: Column, path: Column, name: Column) -> Column:
    """An id that outlives edits: without the span."""
    return F.when(kind == "function", F.concat_ws(":", F.lit("symbol"), path, name)).otherwise(F.concat_ws(":", F.when(kind == "directory", "dir").otherwise("file"), path))

"""Listing, search, paging and reference resolution."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import ascii_lower

NODE_KINDS = ("all", "directory", "file", "function")
EDGE_KINDS = ("all", "contains", "call_candidate", "import", "type_import")
PAGE_LIMIT = 500


def check_limit(limit: int) -> None:
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be 1..{PAGE_LIMIT}")


def of_kind(rows: DataFrame, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}")
    return rows if kind == "all" else rows.where(F.col("kind") == kind)


def cursor(query: tuple, offset: int) -> str:
    """A cursor is good for its own query alone."""
    return f"{hashlib.sha256(json.dumps(query).encode()).hexdigest()}:{offset}"


def offset_of(query: tuple, given: str | None, total: int) -> int:
    if given is None:
        return 0
    key, _, at = given.partition(":")
    if key != cursor(query, 0).partition(":")[0] or not at.isdigit():
        raise ValueError("cursor_query_mismatch")
    if int(at) > total:
        raise ValueError("cursor_outside_result")
    return int(at)


def page(rows: DataFrame, query: tuple, order: list, limit: int, given: str | None = None) -> tuple[DataFrame, int, str | None]:
    """(rows of the page, total, cursor of the next page): a top-n plan without a full sort, and a count."""
    check_limit(limit)
    total = rows.count()
    at = offset_of(query, given, total)
    after = cursor(query, at + limit) if at + limit < total else None
    return rows.orderBy(*order).offset(at).limit(limit), total, after


def matching(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name or path holds ``text``; only ASCII letters are folded, and no character is special."""
    needle = ascii_lower(F.lit(text.strip()))
    return nodes.where(ascii_lower(F.col("name")).contains(needle) | ascii_lower(F.col("path")).contains(needle))


def resolve(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """(ref, status, n, id): a reference is an id, else path:name, else a bare name; the first form with any match decides."""
    hits = None
    for rank, key in enumerate((F.col("id"), F.concat_ws(":", "path", "name"), F.col("name"))):
        found = references.join(nodes.select(key.alias("ref"), "id"), "ref").groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("id")).withColumn("form", F.lit(rank))
        hits = found if hits is None else hits.unionByName(found)
    first = hits.groupBy("ref").agg(F.min_by(F.struct("n", "id"), "form").alias("hit"))
    n = F.coalesce(F.col("hit.n"), F.lit(0))
    status = F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous")
    return references.join(first, "ref", "left").select("ref", status.alias("status"), n.cast("long").alias("n"), F.when(n == 1, F.col("hit.id")).alias("id"))


def edges_touching(edges: DataFrame, node: str, direction: str, kind: str = "all") -> DataFrame:
    side = {"in": "target", "out": "source"}[direction]
    return of_kind(edges, kind, EDGE_KINDS).where(F.col(side) == node)


def child_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("child_count"))


def members(nodes: DataFrame) -> DataFrame:
    """Every node with its true number of children, its place among its siblings, and whether it can be opened."""
    kind = F.when(F.col("kind") == "directory", 0).when(F.col("kind") == "file", 1).otherwise(2)
    rows = nodes.join(child_counts(nodes), "id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    order = Window.partitionBy("parent").orderBy(kind, "path", "id")
    return rows.where("parent IS NOT NULL").withColumn("place", F.row_number().over(order)).withColumn("has_children", F.col("child_count") > 0)


def latest(rows: DataFrame, per: list[str], order: list[Column], n: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, or all, with their places."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return placed if n is None else placed.where(F.col("place") <= n)


def request_problem(page: Column, kind: Column, nodes: Column, edges: Column) -> Column:
    """What is wrong with a request's bounds, first things first; null if nothing is."""
    within = lambda c, top: (c >= 1) & (c <= top)
    return (
        F.when(~within(page, PAGE_LIMIT), "invalid_limit")
        .when(~kind.isin(*NODE_KINDS), "invalid_kind")
        .when(~within(nodes, 500), "invalid_node_budget")
        .when(~within(edges, 2000), "invalid_edge_budget")
    )

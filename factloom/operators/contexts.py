"""Searches from many roots at once, and the frozen context of every entity that stands on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.identity import digest
from factloom.operators import documents
from factloom.session import buckets, dealt, grouped_in_memory, shuffled, stored

SCHEMA = "selection-context.v1"
#: Bytes of source, nodes and examined edges of a context.
SOURCE, NODES, EDGES = 16_000, 40, 120
#: Searches at one node from which on its edges are handed to them.
FREQUENT = 100_000
#: Edges of a node that are put in order as one list; where one has more, all are numbered first and cut to the budget.
LARGE = 2_000
#: Edges that the searches of a bucket look up in a round, if all had as many as the largest node.
LOOKED = 1_000_000
#: Of a node's edges: their ids, their targets, the numbers of edges of these.
LISTS = ("ids", "targets", "ms")


def reach_of_all(edges: DataFrame, roots: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """(root, nodes, edges, unresolved, frontier, truncated): ``traverse.bounded_reach`` from every one of ``roots`` (root) over ``edges`` (id, source, target).

    A round is a level of all searches. A search is a row, whose arrays the budgets bound, and stays in the bucket of its root. A node's edges are a row,
    in the bucket of the node; each has the number of its target's edges, so that sums over what was found last say which edges the budget still
    covers, and no others are joined, however many a node has. A round shuffles the nodes to look up, and the edges back to their searches; a node that very
    many searches are at is handed to where they are. One number of each round reaches the driver: how many searches are at the most frequent node.

    Nodes and unresolved are in the order of discovery, the frontier has each once. Null and repeated roots are left out, edges without a source are
    no one's; an edge that is there twice is examined twice. ``truncated`` is whether a frontier is left. ``edges`` are read three times: what is
    dear to derive should be stored.
    """
    if not 1 <= max_nodes <= 500 or not 1 <= max_edges <= 2000:
        raise ValueError("budgets: nodes 1..500, edges 1..2000")
    spark = edges.sparkSession
    key, name = edges.schema["source"].dataType, edges.schema["id"].dataType
    near, large = _neighbours(edges, max_edges)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    start = F.array(F.struct(F.lit(0).alias("rank"), F.col("root").alias("source"), F.lit(0).alias("before")))
    distinct = stored(roots.select(F.col("root").cast(key)).where("root IS NOT NULL").distinct())
    count = distinct.count()
    n = max(buckets(spark, count), count * large // LOOKED)
    live = dealt(
        distinct.select(
            "root", F.array("root").alias("nodes"), none(name.simpleString()).alias("edges"), none(name.simpleString()).alias("unresolved"), none(key.simpleString()).alias("frontier"), F.lit(1).alias("at"), F.lit(0).alias("examined"), start.alias("ahead"), F.lit(True).alias("open")
        ), n, "root"
    )
    over, most = [], 1
    while most is not None:
        with grouped_in_memory(spark):
            live = dealt(_level(live.where("open"), near, n, max_nodes, max_edges, most > FREQUENT), n, "root", there=True)
        over.append(live.where("NOT open"))
        most = _at_nodes(live.where("open")).agg(F.max("count")).first()[0]
    out = over[0]
    for rows in over[1:]:
        out = out.unionByName(rows)
    return out.select("root", "nodes", "edges", "unresolved", "frontier", (F.size("frontier") > 0).alias("truncated"))


def _neighbours(edges: DataFrame, max_edges: int) -> tuple[DataFrame, int]:
    """(source, ids, targets, ms) in buckets by source: its edges in order, with the number of each target's edges, as many as the budget and one more, which shows that a node was cut;
    and how many of the budget a node has at most."""
    known = edges.where("source IS NOT NULL").select("id", "source", "target")
    degrees = stored(known.groupBy("source").agg(F.count("*").alias("m")))
    rows, large = degrees.agg(F.sum("m"), F.max("m")).first()
    if (large or 0) > LARGE:
        order = Window.partitionBy("source").orderBy("id", "target")
        known = stored(known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_edges + 1).drop("k"))
        rows = known.count()
    n = buckets(edges.sparkSession, rows or 0)
    ends = degrees.select(F.col("source").alias("target"), F.least("m", F.lit(max_edges + 1)).cast("int").alias("m"))
    to = known.join(ends, "target", "left").repartition(n, "source")
    met = F.slice(F.array_sort(F.collect_list(F.struct("id", "target", F.coalesce("m", F.lit(0)).alias("m")))), 1, max_edges + 1)
    near = to.groupBy("source").agg(met.alias("met")).select("source", F.col("met.id").alias("ids"), F.col("met.target").alias("targets"), F.col("met.m").alias("ms"))
    with grouped_in_memory(edges.sparkSession):  # a bucket's rows are few
        return dealt(near, n, "source", there=True), min(large or 0, max_edges)


def _at_nodes(live: DataFrame) -> DataFrame:
    """(source, count): how many searches look up each node next."""
    return live.select(F.explode("ahead.source").alias("source")).groupBy("source").count()


def _level(live: DataFrame, near: DataFrame, n: int, max_nodes: int, max_edges: int, frequent: bool) -> DataFrame:
    queue = live.select("root", F.inline("ahead"))
    covered = [F.slice(c, 1, F.lit(max_edges) - F.col("before")).alias(c) for c in LISTS]
    look = lambda q, e: q.join(e, "source").select("root", "rank", "before", F.size("ids").alias("n"), *covered)
    if frequent:
        # at most one node in FREQUENT rows of the queue
        many = stored(_at_nodes(live).where(F.col("count") > FREQUENT).select("source"))
        here = F.broadcast(near.join(F.broadcast(many), "source", "left_semi"))
        looked = look(queue.join(F.broadcast(many), "source", "left_anti"), shuffled(near)).unionByName(look(queue.join(F.broadcast(many), "source", "left_semi"), here))
    else:
        looked = look(queue, shuffled(near))
    level = looked.repartition(n, "root").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("rank", "before", "n", *LISTS))).alias("looked"))

    rows = live.join(shuffled(level), "root", "left").withColumn("looked", F.coalesce("looked", F.array().cast(level.schema["looked"].dataType)))
    rows = rows.withColumns({c: F.flatten(f"looked.{c}") for c in LISTS} | {"last": F.try_element_at("looked", F.lit(-1))})
    total = F.coalesce(F.col("last.before") + F.col("last.n"), F.col("examined"))
    # whoever is met first while there is room is a node; the others are the frontier
    rows = rows.withColumn("fresh", F.array_except(F.array_compact("targets"), "nodes"))
    room = F.lit(max_nodes) - F.size("nodes")
    rows = rows.withColumns({"total": total, "cut": total >= max_edges, "found": F.slice("fresh", 1, room), "beyond": F.slice("fresh", room + 1, F.lit(max_edges))})
    rows = rows.withColumn("now", F.concat("nodes", "found"))
    to = lambda i: F.get("targets", i)
    taken = F.when(F.size("beyond") == 0, F.filter("ids", lambda _, i: to(i).isNotNull())).otherwise(F.filter("ids", lambda _, i: F.array_contains("now", to(i))))
    unresolved = F.filter("ids", lambda _, i: to(i).isNull())
    # not looked at, or cut in the middle
    rest = F.slice("nodes", F.col("at") + F.col("last.rank") + F.when(F.col("total") > max_edges, 0).otherwise(1), F.lit(max_nodes))
    kept = F.when(F.col("cut"), F.concat("frontier", "beyond", rest, "found")).otherwise(F.concat("frontier", "beyond"))

    def behind(a: Column, t: Column) -> Column:
        item = F.struct(F.size(a.ahead).alias("rank"), t.alias("source"), a.before.alias("before"))
        m = F.element_at(a.ms, F.array_position(a.targets, t).cast("int"))
        return F.struct((a.before + m).alias("before"), F.when(a.before < max_edges, F.array_append(a.ahead, item)).otherwise(a.ahead).alias("ahead"), a.targets.alias("targets"), a.ms.alias("ms"))

    first = F.struct(F.col("total").alias("before"), F.expr("slice(ahead, 1, 0)").alias("ahead"), "targets", "ms")
    rows = rows.withColumn("open", ~F.col("cut") & (F.size("found") > 0))
    return rows.select(
        "root", F.col("now").alias("nodes"), F.concat("edges", taken).alias("edges"), F.concat("unresolved", unresolved).alias("unresolved"), F.array_distinct(kept).alias("frontier"),
        (F.size("nodes") + 1).alias("at"), F.least("total", F.lit(max_edges)).cast("int").alias("examined"), F.when(F.col("open"), F.aggregate("found", first, behind).ahead).otherwise(F.expr("slice(ahead, 1, 0)")).alias("ahead"), "open",
    )


def frozen(analysis: str, spans: DataFrame, files: DataFrame, edges: DataFrame, limitations: str) -> DataFrame:
    """(selection, id, window, window_cut, nodes, edges, unresolved, frontier, truncated): the context of each of ``spans`` (id, path, lo, hi), its source and
    what it reaches, under an id that is the digest of it all. Lists are in order, so that equal contexts have equal ids."""
    source = documents.windows(spans, files, SOURCE).select("id", "window", F.col("truncated").alias("window_cut"))
    reach = reach_of_all(stored(edges.select("id", "source", "target")), spans.select(F.col("id").alias("root")), NODES, EDGES)
    lists = ("nodes", "edges", "unresolved", "frontier")
    rows = source.join(reach.withColumnRenamed("root", "id"), "id").withColumns({c: F.array_sort(c) for c in lists})
    parts = [F.array_join(c, "\n") for c in lists]
    body = [F.lit(SCHEMA), F.lit(analysis), "id", "window", "window_cut", *parts, "truncated", F.lit(limitations)]
    return rows.select(digest(*body).alias("selection"), "id", "window", "window_cut", *lists, "truncated")

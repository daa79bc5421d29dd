"""Q14: frozen contexts, and G4 from many roots."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import contexts
from factloom.plans import inputs
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.session import stored
from factloom.sources.tables import table

#: The search from every root of roots(root) over e(id, source, target), a state per step of each, as got(root, nodes, edges, unresolved, frontier).
REACH = """, adj AS (SELECT source, list(id ORDER BY id, target) AS ids, list(target ORDER BY id, target) AS targets FROM e GROUP BY source),
 s AS (SELECT root, 0 AS n, 1 AS qi, 1 AS ei, [root] AS nodes, CAST([] AS VARCHAR[]) AS edges, CAST([] AS VARCHAR[]) AS unresolved, CAST([] AS VARCHAR[]) AS frontier FROM roots
  UNION ALL SELECT root, CASE WHEN has THEN n+1 ELSE n END, CASE WHEN has THEN qi ELSE qi+1 END, CASE WHEN has THEN ei+1 ELSE 1 END,
   CASE WHEN fresh AND len(nodes)<{nodes} THEN list_append(nodes, t) ELSE nodes END, CASE WHEN t IS NOT NULL AND (NOT fresh OR len(nodes)<{nodes}) THEN list_append(edges, eid) ELSE edges END,
   CASE WHEN has AND t IS NULL THEN list_append(unresolved, eid) ELSE unresolved END, CASE WHEN fresh AND len(nodes)>={nodes} THEN list_append(frontier, t) ELSE frontier END
  FROM (SELECT s.*, ei<=coalesce(len(ids), 0) AS has, targets[ei] AS t, ids[ei] AS eid, targets[ei] IS NOT NULL AND NOT list_contains(nodes, targets[ei]) AS fresh FROM s LEFT JOIN adj ON adj.source=nodes[qi])
  WHERE qi<=len(nodes) AND n<{edges}),
 got AS (SELECT root, nodes, edges, unresolved, CASE WHEN n<{edges} THEN list_distinct(frontier) ELSE list_distinct(list_concat(frontier, list_slice(nodes, CASE WHEN ei<=coalesce(len(ids), 0) THEN qi ELSE qi+1 END, len(nodes)))) END AS frontier
  FROM s LEFT JOIN adj ON adj.source=nodes[qi] WHERE qi>len(nodes) OR n={edges})"""
LIMITS = "static candidates"


@query(
    "q14_frozen_contexts",
    using("cat", "sym", "calls", "bad", "edges", recursive=True)
    + ", e AS (SELECT id, source, target FROM calle), roots AS (SELECT id AS root FROM sym)"
    + REACH.format(nodes=contexts.NODES, edges=contexts.EDGES)
    + """, l AS (SELECT id, line, strlen(line)>16000 AS window_cut, CASE WHEN strlen(line)<=16000 THEN line ELSE left(line, list_max(list_filter(range(4000, 16001), lambda k: strlen(left(line, CAST(k AS BIGINT)))<=16000))) END AS w FROM sym)
 SELECT sha256(concat_ws(chr(0), 'selection-context.v1', 'driver', id, w, CAST(window_cut AS VARCHAR), array_to_string(list_sort(nodes), chr(10)), array_to_string(list_sort(edges), chr(10)), array_to_string(list_sort(unresolved), chr(10)), array_to_string(list_sort(frontier), chr(10)), CAST(len(frontier)>0 AS VARCHAR), 'static candidates')) AS selection,
 id, window_cut, len(nodes) AS n_nodes, len(edges) AS n_edges, len(unresolved) AS n_unresolved, len(frontier)>0 AS truncated FROM got JOIN l ON id=root""",
)
def q14(spark, d):
    spans = inputs.sym(spark, d).select("id", "path", F.col("start").alias("lo"), F.col("end").alias("hi"))
    rows = contexts.frozen("driver", spans, inputs.cat(spark, d).select("path", "text"), inputs.call_edges(spark, d), LIMITS)
    size = lambda c: F.size(c).cast("long")
    return rows.select("selection", "id", "window_cut", size("nodes").alias("n_nodes"), size("edges").alias("n_edges"), size("unresolved").alias("n_unresolved"), "truncated")


@query(
    "g4_reach_of_parts",
    """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey||':'||l_linenumber||':'||l_partkey AS k, 'order:'||l_orderkey AS o, 'part:'||l_partkey AS p, l_linenumber FROM lineitem),
 e AS (SELECT 'lists:'||k AS id, o AS source, CASE WHEN l_linenumber<>7 THEN p END AS target FROM l UNION ALL SELECT 'in:'||k, p, o FROM l), roots AS (SELECT DISTINCT p AS root FROM l)"""
    + REACH.format(nodes=contexts.NODES, edges=contexts.EDGES)
    + """ SELECT root, md5(array_to_string(nodes, ',')) AS nodes, md5(array_to_string(edges, ',')) AS edges, array_to_string(unresolved, ',') AS unresolved, md5(array_to_string(list_sort(frontier), ',')) AS frontier, len(frontier)>0 AS truncated FROM got""",
)
def g4_parts(spark, d):
    """From every part, through the orders that list it to the other parts in them: both budgets cut. Nodes and edges are in the order of discovery.

    A node is a number while it is searched for, even for a part and odd for an order (a key above 2^62 is an error), and gets its name at the end."""
    rows = stored(table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("o"), "l_linenumber", F.col("l_partkey").cast("long").alias("p")).distinct())
    edge = lambda what: F.concat_ws(":", F.lit(what), F.col("o").cast("string"), F.col("l_linenumber").cast("string"), F.col("p").cast("string"))
    order, part = F.col("o") * 2 + 1, F.col("p") * 2
    both = F.array(
        F.struct(edge("lists").alias("id"), order.alias("source"), F.when(F.col("l_linenumber") != 7, part).alias("target")),
        F.struct(edge("in").alias("id"), part.alias("source"), order.alias("target")),
    )
    e = rows.select(F.inline(both))
    got = contexts.reach_of_all(e, rows.select(part.alias("root")), contexts.NODES, contexts.EDGES)
    named = lambda x: F.concat(F.when(x.bitwiseAND(F.lit(1)) == 1, "order:").otherwise("part:"), F.shiftright(x, 1).cast("string"))
    joined = lambda c: F.array_join(c, ",")
    return got.select(
        named(F.col("root")).alias("root"), F.md5(joined(F.transform("nodes", named))).alias("nodes"), F.md5(joined("edges")).alias("edges"), joined("unresolved").alias("unresolved"), F.md5(joined(F.array_sort(F.transform("frontier", named)))).alias("frontier"), "truncated"
    )

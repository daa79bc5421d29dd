"""G: graph assembly and traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.identity import digest
from factloom.operators import catalog, graph, ranks, traverse
from factloom.plans import inputs
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.session import checkpointed, shuffled, stored
from factloom.sources import projections
from factloom.sources.tables import table

E = using("cat", "sym", "calls", "bad", "edges")
#: Reachability closure of a relation e(a, b), for oracles.
CLOSE = ", tc AS (SELECT a, b FROM e UNION SELECT tc.a, e.b FROM tc JOIN e ON tc.b=e.a)"

#: Components of the nodes n(id) of e(a, b), as comp(id, comp), and the levels of the condensation, leaves first, as top(comp, level).
COMPS = CLOSE + """, m AS (SELECT x.a, min(x.b) AS c FROM tc x JOIN tc y ON x.a=y.b AND x.b=y.a GROUP BY x.a),
 comp AS (SELECT id, least(id, coalesce(c, id)) AS comp FROM n LEFT JOIN m ON m.a=n.id)"""
LEVELS = """, cond AS (SELECT DISTINCT x.comp AS ca, y.comp AS cb FROM e JOIN comp x ON x.id=a JOIN comp y ON y.id=b WHERE x.comp<>y.comp),
 lv AS (SELECT comp, 0 AS level FROM comp UNION SELECT ca, level+1 FROM lv JOIN cond ON cb=lv.comp), top AS (SELECT comp, max(level) AS level FROM lv GROUP BY comp)"""
ENDS = ", n AS (SELECT a AS id FROM e UNION SELECT b FROM e)"
FILE_GRAPH = """, p AS (SELECT doc_id, path, blob FROM cat WHERE disposition='captured'),
 e AS (SELECT DISTINCT s.path AS a, t.path AS b FROM imports i JOIN p s ON s.doc_id=i.doc_id JOIN p t ON t.doc_id=i.target_doc WHERE s.path<>t.path)"""
#: A state per step of the search: an edge is examined, or the next node is taken from the queue.
BOUNDED = """, root AS (SELECT source FROM e WHERE target IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1),
 adj AS (SELECT source, list(id ORDER BY id) AS ids, list(target ORDER BY id) AS targets FROM e GROUP BY source),
 s AS (SELECT 0 AS n, 1 AS qi, 1 AS ei, [source] AS nodes, CAST([] AS VARCHAR[]) AS edges, CAST([] AS VARCHAR[]) AS unresolved, CAST([] AS VARCHAR[]) AS frontier FROM root
  UNION ALL SELECT CASE WHEN has THEN n+1 ELSE n END, CASE WHEN has THEN qi ELSE qi+1 END, CASE WHEN has THEN ei+1 ELSE 1 END,
   CASE WHEN fresh AND len(nodes)<100 THEN list_append(nodes, t) ELSE nodes END, CASE WHEN t IS NOT NULL AND (NOT fresh OR len(nodes)<100) THEN list_append(edges, eid) ELSE edges END,
   CASE WHEN has AND t IS NULL THEN list_append(unresolved, eid) ELSE unresolved END, CASE WHEN fresh AND len(nodes)>=100 THEN list_append(frontier, t) ELSE frontier END
  FROM (SELECT s.*, ei<=coalesce(len(ids), 0) AS has, targets[ei] AS t, ids[ei] AS eid, targets[ei] IS NOT NULL AND NOT list_contains(nodes, targets[ei]) AS fresh FROM s LEFT JOIN adj ON adj.source=nodes[qi])
  WHERE qi<=len(nodes) AND n<400),
 last AS (SELECT s.*, ei<=coalesce(len(ids), 0) AS cut FROM s LEFT JOIN adj ON adj.source=nodes[qi] WHERE qi>len(nodes) OR n=400)
 SELECT 'node' AS part, unnest(nodes) AS id FROM last UNION ALL SELECT 'edge', unnest(edges) FROM last UNION ALL SELECT 'unresolved', unnest(unresolved) FROM last
 UNION ALL SELECT 'frontier', id FROM (SELECT unnest(frontier) AS id FROM last UNION SELECT unnest(list_slice(nodes, CASE WHEN cut THEN qi ELSE qi+1 END, len(nodes))) FROM last WHERE n=400)"""


@query("g1_graph_nodes", using("cat", "dirs", "sym", "nodes") + """ SELECT id, path, name, kind, parent, "start", "end", function_count, disposition FROM nodes""")
def g1(spark, d):
    return inputs.nodes(spark, d)


@query("g2_call_resolution", E + " SELECT id, owner AS source, CASE WHEN basis='resolved' THEN found END AS target, label, basis FROM res")
def g2(spark, d):
    return inputs.call_edges(spark, d).select("id", "source", "target", "label", "basis")


@query("g3_import_edges", using("cat", "imports") + """ SELECT i.id, 'file:'||i.path AS source, 'file:'||c.path AS target, CASE WHEN type_only THEN 'type_import' ELSE 'import' END AS kind FROM imports i LEFT JOIN cat c ON c.doc_id=i.target_doc""")
def g3(spark, d):
    return graph.import_edges(inputs.imports(spark, d), inputs.cat(spark, d)).select("id", "source", "target", "kind")


@query("g4_reach_imports", using("cat", "imports", recursive=True) + ", e AS (SELECT doc_id AS a, target_doc AS b FROM imports WHERE NOT type_only AND target_doc IS NOT NULL), r AS (SELECT CAST(1 AS BIGINT) AS id UNION SELECT e.b FROM r JOIN e ON e.a=r.id) SELECT id FROM r")
def g4(spark, d):
    e = inputs.imports(spark, d).where("NOT type_only").select(F.col("doc_id").alias("a"), F.col("target_doc").alias("b"))
    return traverse.reachable(e, spark.createDataFrame([(1,)], "id long")).select("id")


@query("g4_reach_levels", using("nations", recursive=True) + ", r AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS level UNION SELECT ne.b, r.level+1 FROM r JOIN ne ON ne.a=r.id WHERE r.level<4) SELECT id, min(level) AS level FROM r GROUP BY id")
def g4_levels(spark, d):
    return traverse.reachable(checkpointed(projections.nation_edges(spark, d)), spark.createDataFrame([(0,)], "id long"), 4)


@query("g4_bounded_reach", E.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT id, source, target FROM calle)" + BOUNDED)
def g4_bounded(spark, d):
    return bounded(spark, checkpointed(inputs.call_edges(spark, d).select("id", "source", "target")))


@query(
    "g4_bounded_orders",
    """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey||':'||l_linenumber||':'||l_partkey AS k, 'order:'||l_orderkey AS o, 'part:'||l_partkey AS p, l_linenumber FROM lineitem),
 e AS (SELECT 'lists:'||k AS id, o AS source, CASE WHEN l_linenumber<>7 THEN p END AS target FROM l UNION ALL SELECT 'in:'||k, p, o FROM l)"""
    + BOUNDED,
)
def g4_orders(spark, d):
    """Orders and their parts, to and fro: wide enough for both budgets to cut the search; seventh lines are unresolved."""
    k = F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")))  # a line number may repeat
    named = lambda what, c: F.concat(F.lit(f"{what}:"), F.col(c).cast("string"))
    rows = table(spark, d, "lineitem").select(k.alias("k"), named("order", "l_orderkey").alias("o"), named("part", "l_partkey").alias("p"), "l_linenumber").distinct()
    lists = rows.select(F.concat(F.lit("lists:"), "k").alias("id"), F.col("o").alias("source"), F.when(F.col("l_linenumber") != 7, F.col("p")).alias("target"))
    return bounded(spark, checkpointed(lists.unionByName(rows.select(F.concat(F.lit("in:"), "k"), "p", "o").toDF("id", "source", "target"))))


def bounded(spark, e):
    """The parts of a search from the node with the most resolved edges."""
    root = e.where("target IS NOT NULL").groupBy("source").count().orderBy(F.desc("count"), "source").first()
    got = traverse.bounded_reach(e, root[0] if root else "", 100, 400)
    rows = [("node", x) for x in sorted(got.nodes)] + [("edge", x) for x in sorted(got.edges)] + [("unresolved", x) for x in got.unresolved] + [("frontier", x) for x in sorted(got.frontier)]
    return spark.createDataFrame(rows, "part string, id string")


SCC = " SELECT id, min(o) AS comp FROM (SELECT a AS id, b AS o FROM tc WHERE (b,a) IN (SELECT a,b FROM tc) UNION SELECT a, a FROM n) GROUP BY id"


@query("g5_recursive_components", E.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT DISTINCT source AS a, target AS b FROM calle WHERE target IS NOT NULL)" + CLOSE + " SELECT x.a AS id, min(x.b) AS comp FROM tc x JOIN tc y ON x.a=y.b AND x.b=y.a GROUP BY x.a")
def g5(spark, d):
    e = inputs.call_edges(spark, d).where("target IS NOT NULL").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return traverse.strong_components(e, singletons=False)


@query("g5_components_of_errors", using("errors", recursive=True) + ", e AS (SELECT a, b FROM ee), n AS (SELECT a FROM ee UNION SELECT b FROM ee)" + CLOSE + ", m AS (SELECT DISTINCT x.a, x.b FROM tc x JOIN tc y ON x.a=y.b AND x.b=y.a) SELECT n.a AS id, least(n.a, coalesce(min(m.b), n.a)) AS comp FROM n LEFT JOIN m ON m.a=n.a GROUP BY n.a")
def g5_errors(spark, d):
    return traverse.strong_components(projections.error_edges(spark, d))


@query("g6_import_graph", using("cat", "imports") + ", p AS (SELECT doc_id, path FROM cat WHERE disposition='captured') SELECT DISTINCT i.path AS a, t.path AS b FROM imports i JOIN p s ON s.doc_id=i.doc_id JOIN p t ON t.doc_id=i.target_doc WHERE s.path<>t.path")
def g6(spark, d):
    return file_graph(spark, d)


def file_graph(spark, d):
    """Imports among captured files, without loops."""
    p = inputs.cat(spark, d).where("disposition = 'captured'").select("doc_id", "path")
    i = inputs.imports(spark, d).join(shuffled(p.select(F.col("doc_id"))), "doc_id", "left_semi")
    rows = i.join(shuffled(p.select(F.col("doc_id").alias("target_doc"), F.col("path").alias("b"))), "target_doc")
    return rows.select(F.col("path").alias("a"), "b").where("a <> b").distinct()


@query("g7_import_components", using("cat", "imports", recursive=True) + FILE_GRAPH + ENDS + COMPS + " SELECT id, comp FROM comp")
def g7(spark, d):
    return traverse.strong_components(file_graph(spark, d))


@query("g7_nation_components", using("nations", recursive=True) + ", e AS (SELECT a, b FROM ne), n AS (SELECT a FROM e UNION SELECT b FROM e)" + CLOSE + ", m AS (SELECT DISTINCT x.a, x.b FROM tc x JOIN tc y ON x.a=y.b AND x.b=y.a) SELECT n.a AS id, least(n.a, coalesce(min(m.b), n.a)) AS comp FROM n LEFT JOIN m ON m.a=n.a GROUP BY n.a", also="g7_nation_components_whole")
def g7_nations(spark, d):
    """By rounds alone, as a graph too large for one task is."""
    return traverse.strong_components(checkpointed(projections.nation_edges(spark, d)), rest=0)


MERKLE = (
    using("cat", "imports", recursive=True)
    + FILE_GRAPH
    + ", n AS (SELECT path AS id FROM p)"
    + COMPS
    + LEVELS
    + """, own AS (SELECT comp, level, string_agg(id||'='||blob, chr(10) ORDER BY id||'='||blob) AS own FROM comp JOIN p ON path=id JOIN top USING (comp) GROUP BY comp, level),
 r AS (SELECT 0 AS k, comp, level, own, CASE WHEN level=0 THEN sha256(own) END AS closure FROM own
  UNION ALL SELECT k+1, r.comp, level, own, CASE WHEN level=k+1 THEN sha256(own||chr(0)||kids) ELSE closure END
  FROM r LEFT JOIN (SELECT ca, string_agg(r.closure, chr(10) ORDER BY r.closure) AS kids FROM cond JOIN r ON r.comp=cb GROUP BY ca) ON ca=r.comp WHERE k<(SELECT max(level) FROM top)),
 merkle AS (SELECT id, blob, comp, closure FROM comp JOIN p ON path=id JOIN r USING (comp) WHERE k=(SELECT max(level) FROM top))"""
)


def merkle(spark, d):
    """(id, hash, comp, closure) of every captured file."""
    e = checkpointed(file_graph(spark, d))
    files = inputs.cat(spark, d).where("disposition = 'captured'").select(F.col("path").alias("id"), F.col("blob").alias("hash"))
    comps = traverse.strong_components(e)
    alone = files.select("id").join(shuffled(comps.select("id")), "id", "left_anti").select("id", F.col("id").alias("comp"))
    comps = checkpointed(comps.unionByName(alone))
    return files.join(shuffled(comps), "id").join(shuffled(traverse.closure_digests(files, e, comps)), "comp")


@query("g8_merkle_closure", MERKLE + " SELECT id, comp, closure FROM merkle")
def g8(spark, d):
    return merkle(spark, d).select("id", "comp", "closure")


@query("g9_file_keys", MERKLE + " SELECT id, sha256('bundle-1'||chr(0)||id||chr(0)||blob||chr(0)||closure) AS key FROM merkle")
def g9(spark, d):
    return merkle(spark, d).select("id", digest(F.lit("bundle-1"), "id", "hash", "closure").alias("key"))


@query(
    "x6_incremental_closures",
    using("cat", "imports", recursive=True)
    + FILE_GRAPH
    + CLOSE
    + """, changed AS (SELECT path AS id FROM p WHERE doc_id%97=3), touched AS (SELECT id FROM changed UNION SELECT a FROM tc JOIN changed ON b=id)
 SELECT path AS id, CASE WHEN path IN (SELECT id FROM changed) THEN 'own_content' WHEN path IN (SELECT id FROM touched) THEN 'dependency' ELSE 'unchanged' END AS verdict, path IN (SELECT id FROM touched) AS fresh FROM p""",
)
def x6_incremental(spark, d):
    """Every 97th file is edited: closure digests brought up to date from the old ones, and whose moved by its own content or by what it depends on."""
    e = stored(file_graph(spark, d))
    old = stored(inputs.cat(spark, d).where("disposition = 'captured'").select("doc_id", F.col("path").alias("id"), F.col("blob").alias("hash")))
    new = old.select("id", F.when(F.col("doc_id") % 97 == 3, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    comps = traverse.strong_components(e)
    comps = stored(comps.unionByName(old.select("id").join(comps.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp"))))
    before = stored(traverse.closure_digests(old, e, comps))
    after = traverse.changed_closures(before, old, new, e, comps).join(before.select("comp", F.col("closure").alias("was")), "comp")
    rows = comps.join(shuffled(after), "comp").join(shuffled(old.select("id", F.col("hash").alias("old_hash"))), "id").join(shuffled(new), "id")
    verdict = F.when(F.col("hash") != F.col("old_hash"), "own_content").when(F.col("closure") != F.col("was"), "dependency").otherwise("unchanged")
    return rows.select("id", verdict.alias("verdict"), "fresh")


@query("g10_import_closure", using("cat", "imports", recursive=True) + ", e AS (SELECT i.id AS import_id, i.path AS a, c.path AS b FROM imports i LEFT JOIN cat c ON c.doc_id=i.target_doc WHERE NOT type_only), s AS (SELECT path FROM cat WHERE doc_id=1), r AS (SELECT path AS id FROM s UNION SELECT e.b FROM r JOIN e ON e.a=r.id WHERE e.b IS NOT NULL) SELECT import_id, a FROM e WHERE b IS NULL AND a IN (SELECT id FROM r)")
def g10(spark, d):
    seed = inputs.cat(spark, d).where("doc_id = 1").select(F.col("path").alias("id"))
    return traverse.import_closure(inputs.import_paths(spark, d), seed)[1].select("import_id", "a")


@query(
    "g10_closure_report",
    using("cat", "imports", recursive=True)
    + """, e AS (SELECT i.path AS a, c.path AS b, CASE i.doc_id%4 WHEN 0 THEN './gone_'||i.doc_id WHEN 1 THEN '..' WHEN 2 THEN 'pkg_'||i.doc_id ELSE '.hidden' END AS specifier FROM imports i LEFT JOIN cat c ON c.doc_id=i.target_doc WHERE NOT type_only),
 r AS (SELECT path AS id FROM cat WHERE doc_id=1 UNION SELECT e.b FROM r JOIN e ON e.a=r.id WHERE e.b IS NOT NULL), u AS (SELECT specifier FROM e WHERE b IS NULL AND a IN (SELECT id FROM r))
 SELECT 'file' AS part, id FROM r UNION ALL (SELECT 'relative', specifier FROM (SELECT DISTINCT specifier FROM u WHERE regexp_matches(specifier, '^\\.\\.?(/|$)')) ORDER BY specifier LIMIT 20)
 UNION ALL SELECT 'bare', CAST(count(*) FILTER (NOT regexp_matches(specifier, '^\\.\\.?(/|$)')) AS VARCHAR) FROM u""",
)
def g10_report(spark, d):
    seed = inputs.cat(spark, d).where("doc_id = 1").select(F.col("path").alias("id"))
    rows = checkpointed(inputs.import_paths(spark, d))
    files, unresolved = traverse.import_closure(rows, seed)
    k, doc = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("./gone_"), doc)).when(k == 1, "..").when(k == 2, F.concat(F.lit("pkg_"), doc)).otherwise(".hidden")
    named = unresolved.join(rows.select(F.col("id").alias("import_id"), name.alias("specifier")), "import_id")
    return traverse.closure_report(files, named)


@query("g11_callees_first", E.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT DISTINCT source AS a, target AS b FROM calle WHERE target IS NOT NULL)" + ENDS + COMPS + LEVELS + " SELECT comp, level FROM top")
def g11(spark, d):
    e = checkpointed(inputs.call_edges(spark, d).where("target IS NOT NULL").select(F.col("source").alias("a"), F.col("target").alias("b")))
    comps = checkpointed(traverse.strong_components(e))
    return traverse.topological_levels(e, comps)


SIGNED = (
    using("nations", recursive=True)
    + """, st AS (SELECT a AS id, b AS t, 1 AS s FROM ne UNION SELECT b, a, -1 FROM ne),
 l1 AS (SELECT t AS id, max(s) AS distance FROM st WHERE id=0 AND t<>0 GROUP BY t),
 l2 AS (SELECT st.t AS id, max(l1.distance+s) AS distance FROM l1 JOIN st ON st.id=l1.id WHERE st.t<>0 AND st.t NOT IN (SELECT id FROM l1) GROUP BY st.t),
 l3 AS (SELECT st.t AS id, max(l2.distance+s) AS distance FROM l2 JOIN st ON st.id=l2.id WHERE st.t<>0 AND st.t NOT IN (SELECT id FROM l1 UNION SELECT id FROM l2) GROUP BY st.t),
 two AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS distance UNION ALL SELECT id, distance FROM l1 UNION ALL SELECT id, distance FROM l2)"""
)


@query("g13_signed_levels", SIGNED + " SELECT id, distance FROM two")
def g13(spark, d):
    return traverse.signed_levels(checkpointed(projections.nation_edges(spark, d)), spark.createDataFrame([(0,)], "id long"), 2)


@query("g14_focus_model", SIGNED + ", w AS (SELECT id, distance, row_number() OVER (ORDER BY abs(distance), id) AS rank FROM (SELECT * FROM two UNION ALL SELECT * FROM l3)) SELECT id, distance, rank, rank<=12 AS drawn FROM w")
def g14(spark, d):
    e = checkpointed(projections.nation_edges(spark, d))
    levels = traverse.signed_levels(e, spark.createDataFrame([(0,)], "id long"), 3)
    return traverse.rank_by_distance(levels, 12).select("id", "distance", "rank", "drawn")


def folds_sql(drawn: str) -> str:
    """SQL of what is folded when of all levels those are drawn for which ``drawn`` holds."""
    walk = lambda name, way: f"""{name} AS (SELECT id, id AS at FROM w WHERE NOT drawn UNION ALL SELECT {name}.id, {way}.nxt FROM {name} JOIN {way} ON {way}.id={name}.at JOIN w ON w.id={name}.at WHERE NOT w.drawn)"""
    step = lambda name, sign: f"""{name} AS (SELECT x.id, min(y.id) AS nxt FROM w x JOIN st ON st.id=x.id JOIN w y ON y.id=st.t WHERE abs(y.distance){sign}abs(x.distance) GROUP BY x.id)"""
    return (
        SIGNED
        + f""", w AS (SELECT id, distance, {drawn} AS drawn FROM (SELECT *, row_number() OVER (ORDER BY abs(distance), id) AS rank FROM (SELECT * FROM two UNION ALL SELECT * FROM l3))),
 {step("i", "<")}, {step("o", ">")}, {walk("wi", "i")}, {walk("wo", "o")},
 f AS (SELECT w.id, wi.at AS inward, wo.at AS outward FROM w LEFT JOIN (SELECT wi.* FROM wi JOIN w ON w.id=wi.at AND w.drawn) wi ON wi.id=w.id LEFT JOIN (SELECT wo.* FROM wo JOIN w ON w.id=wo.at AND w.drawn) wo ON wo.id=w.id WHERE NOT w.drawn),
 k AS (SELECT CASE WHEN inward<>outward THEN 'chain' WHEN inward IS NOT NULL THEN 'tail' ELSE 'unattributed' END AS kind, inward AS a, CASE WHEN inward<>outward THEN outward END AS b, id FROM f)
 SELECT kind, a, b, count(*) AS n, array_to_string(list_slice(list(id ORDER BY id), 1, 24), ',') AS members FROM k GROUP BY kind, a, b"""
    )


@query("g14_focus_folds", folds_sql("rank<=8"))
def g14_folds(spark, d):
    """What a budget of eight boxes folds: tails alone, since the nearest are drawn."""
    e = checkpointed(projections.nation_edges(spark, d))
    levels = traverse.signed_levels(e, spark.createDataFrame([(0,)], "id long"), 3)
    return traverse.folds(checkpointed(traverse.rank_by_distance(levels, 8)), e)


@query("g14_picked_folds", folds_sql("id=0 OR id%3=1"))
def g14_picked(spark, d):
    """What is folded when a third of the nations is picked: chains between drawn ones too."""
    e = checkpointed(projections.nation_edges(spark, d))
    levels = traverse.signed_levels(e, spark.createDataFrame([(0,)], "id long"), 3)
    return traverse.folds(checkpointed(levels.withColumn("drawn", F.expr("id = 0 OR id % 3 = 1"))), e)


@query("g18_merged_focus", using("nations") + " SELECT 0::BIGINT AS id UNION SELECT b FROM ne WHERE a=0 UNION SELECT a FROM ne WHERE b=0")
def g18(spark, d):
    e = checkpointed(projections.nation_edges(spark, d))
    root = spark.createDataFrame([(0,)], "id long")
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return traverse.reachable(e, root, 1).select("id").unionByName(traverse.reachable(back, root, 1).select("id")).dropDuplicates(["id"])


@query("g20_selection_across_views", using("cat", "dirs", "sym", "nodes") + " SELECT s.id, CASE WHEN s.doc_id%4=0 THEN 'other_version' WHEN n.id IS NULL THEN 'not_found' ELSE 'found' END AS status FROM (SELECT doc_id, CASE WHEN doc_id%4=1 THEN 'file:gone/'||doc_id ELSE 'file:'||path END AS id FROM cat) s LEFT JOIN nodes n ON n.id=s.id")
def g20(spark, d):
    k = F.col("doc_id") % 4
    picked = inputs.cat(spark, d).select(
        F.when(k == 1, F.concat(F.lit("file:gone/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("file:"), "path")).alias("id"), F.when(k == 0, "v0").otherwise("v1").alias("version")
    )
    there = catalog.with_directories(inputs.cat(spark, d)).select(F.concat(F.when(F.col("kind") == "directory", "dir:").otherwise("file:"), "path").alias("id"), F.lit(True).alias("there"))
    status = F.when(F.col("version") != "v1", "other_version").when(F.col("there"), "found").otherwise("not_found")
    return picked.join(there, "id", "left").select("id", status.alias("status"))


@query("w5_frontier_order", using("nations") + " SELECT a, b, row_number() OVER (ORDER BY a, b) AS k, row_number() OVER (ORDER BY a, b)<=3 AS examined FROM ne WHERE a IN (SELECT b FROM ne WHERE a=0)")
def w5(spark, d):
    e = checkpointed(projections.nation_edges(spark, d))
    front = e.join(e.where("a = 0").select(F.col("b").alias("a")), "a", "left_semi")
    return ranks.numbered(front, [F.col("a"), F.col("b")], "k").withColumn("examined", F.col("k") <= 3)  # a budget of three edges


@query("v8_order_paths", "SELECT c_nationkey, s_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON s_suppkey=l_suppkey GROUP BY ALL")
def v8_paths(spark, d):
    """Paths of the customer-order-supplier graph, aggregated by their ends: joins on keys, small sides by their size."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("m"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    per = li.join(s, "l_suppkey").groupBy("l_orderkey", "s_nationkey").agg(F.sum("m").alias("m"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return per.join(o, "l_orderkey").join(c, "c_custkey").groupBy("c_nationkey", "s_nationkey").agg(F.sum("m").alias("n"))

"""Q: listing, search, windows, text structure, histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions.times import epoch_us

from factloom.functions.text import file_kind, line_of
from factloom.operators import documents, graph, search
from factloom.plans import inputs
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.sources import projections
from factloom.sources.tables import table

N = using("cat", "dirs", "sym", "nodes")
E = using("cat", "sym", "calls", "bad", "edges")


@query("q1_list_nodes", N + " SELECT id, path, kind FROM nodes WHERE kind='file' ORDER BY id LIMIT 100 OFFSET 50")
def q1(spark, d):
    rows = search.of_kind(inputs.nodes(spark, d), "file", search.NODE_KINDS).select("id", "path", "kind")
    return search.page(rows, ("nodes", "file", 100), ["id"], 100, search.cursor(("nodes", "file", 100), 50))[0]


@query("q2_list_edges", E + " SELECT id, source, target, basis FROM calle ORDER BY id LIMIT 100")
def q2(spark, d):
    rows = search.of_kind(inputs.call_edges(spark, d), "call_candidate", search.EDGE_KINDS).select("id", "source", "target", "basis")
    return search.page(rows, ("edges", "call_candidate", 100), ["id"], 100)[0]


@query("q3_search", N + " SELECT id, path, name FROM nodes WHERE kind='function' AND (contains(translate(name,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'than') OR contains(translate(path,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'than')) ORDER BY path, name, id LIMIT 500")
def q3(spark, d):
    rows = search.matching(search.of_kind(inputs.nodes(spark, d), "function", search.NODE_KINDS), " ThAn ").select("id", "path", "name")
    return search.page(rows, ("search", "than", "function"), ["path", "name", "id"], 500)[0]


@query("q4_flow_symbols", using("cat", "sym") + " SELECT id FROM sym ORDER BY id LIMIT 100 OFFSET 200")
def q4(spark, d):
    return inputs.sym(spark, d).select("id").orderBy("id").offset(200).limit(100)


@query("q5_page_totals", N + " SELECT kind, count(*) AS total, ceil(count(*)/100.0)::BIGINT AS pages FROM nodes GROUP BY kind")
def q5(spark, d):
    return inputs.nodes(spark, d).groupBy("kind").agg(F.count("*").alias("total"), F.ceil(F.count("*") / 100).alias("pages"))


@query(
    "q6_resolve_references",
    N
    + """, r AS (SELECT DISTINCT CASE i%4 WHEN 0 THEN id WHEN 1 THEN path||':'||name WHEN 2 THEN name ELSE name||'?' END AS ref FROM sym),
 h AS (SELECT ref, 0 AS form, count(*) AS n, min(n1.id) AS id FROM r JOIN nodes n1 ON n1.id=ref GROUP BY ref UNION ALL SELECT ref, 1, count(*), min(n2.id) FROM r JOIN nodes n2 ON n2.path||':'||n2.name=ref GROUP BY ref UNION ALL SELECT ref, 2, count(*), min(n3.id) FROM r JOIN nodes n3 ON n3.name=ref GROUP BY ref),
 b AS (SELECT ref, min(form) AS form FROM h GROUP BY ref)
 SELECT r.ref, CASE WHEN n IS NULL THEN 'not_found' WHEN n=1 THEN 'found' ELSE 'ambiguous' END AS status, coalesce(n,0) AS n, CASE WHEN n=1 THEN id END AS id FROM r LEFT JOIN b ON b.ref=r.ref LEFT JOIN h ON h.ref=b.ref AND h.form=b.form""",
)
def q6(spark, d):
    k = F.col("i") % 4
    ref = F.when(k == 0, F.col("id")).when(k == 1, F.concat_ws(":", "path", "name")).when(k == 2, F.col("name")).otherwise(F.concat("name", F.lit("?")))
    return search.resolve(inputs.nodes(spark, d), inputs.sym(spark, d).select(ref.alias("ref")).distinct())


@query("q7_edges_touching", using("cat", "dirs", "sym", "nodes") + " SELECT 'contains:'||id AS id, parent AS source, id AS target FROM nodes WHERE parent='dir:src1/en' ORDER BY 1 LIMIT 500")
def q7(spark, d):
    rows = search.edges_touching(graph.contains_edges(inputs.nodes(spark, d)), "dir:src1/en", "out", "contains")
    return rows.select("id", "source", "target").orderBy("id").limit(500)


@query(
    "q8_tree_members",
    N
    + """, c AS (SELECT parent AS id, count(*) AS child_count FROM nodes WHERE parent IS NOT NULL GROUP BY parent)
 SELECT n.id, n.parent, n.kind, coalesce(child_count,0) AS child_count, row_number() OVER (PARTITION BY n.parent ORDER BY CASE kind WHEN 'directory' THEN 0 WHEN 'file' THEN 1 ELSE 2 END, path, n.id) AS place, coalesce(child_count,0)>0 AS has_children FROM nodes n LEFT JOIN c USING (id) WHERE n.parent IS NOT NULL""",
)
def q8(spark, d):
    return search.members(inputs.nodes(spark, d)).select("id", "parent", "kind", "child_count", "place", "has_children")


@query("q9_child_counts", N + " SELECT parent AS id, count(*) AS child_count FROM nodes WHERE parent IS NOT NULL GROUP BY parent")
def q9(spark, d):
    return search.child_counts(inputs.nodes(spark, d))


@query("q10_file_kinds", using("cat") + " SELECT CASE WHEN regexp_matches(path,'\\.(js|ts)$') THEN 'code' WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.json' THEN 'config' WHEN path LIKE '%.png' THEN 'binary' ELSE 'text' END AS file_kind, count(*) AS n FROM cat GROUP BY 1")
def q10(spark, d):
    return inputs.cat(spark, d).groupBy(file_kind(F.col("path")).alias("file_kind")).agg(F.count("*").alias("n"))


SECTIONS = (
    using("markdown")
    + """, l AS (SELECT path, strlen(text) AS total, unnest(string_split(text,chr(10))) AS line, unnest(range(len(string_split(text,chr(10))))) AS i FROM md),
 o AS (SELECT *, coalesce(sum(strlen(line)+1) OVER w,0) AS "start", coalesce(sum(CASE WHEN starts_with(line,'```') THEN 1 ELSE 0 END) OVER w,0) AS f FROM l WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT path, trim(regexp_replace(line,'^#+ ','')) AS title, CAST(length(regexp_extract(line,'^(#+) ',1)) AS BIGINT) AS level, CAST("start" AS BIGINT) AS "start", CAST(coalesce(lead("start") OVER (PARTITION BY path ORDER BY i), total) AS BIGINT) AS "end" FROM o WHERE f%2=0 AND regexp_matches(line,'^#{1,6} ')"""
)


@query("q11_markdown_sections", SECTIONS)
def q11(spark, d):
    return documents.sections(inputs.markdown(spark, d))


@query("q12_catalog_lookup", using("cat", "sym") + " SELECT s.id, c.bytes, c.disposition FROM sym s LEFT JOIN (SELECT * FROM cat WHERE disposition='captured') c USING (path)")
def q12(spark, d):
    c = inputs.cat(spark, d).where("disposition = 'captured'").select("path", "bytes", "disposition")
    return inputs.sym(spark, d).select("id", "path").join(c, "path", "left").select("id", "bytes", "disposition")


@query(
    "q13_source_window",
    using("cat", "sym")
    + """ SELECT id, "start" AS w_start, i+1 AS start_line, strlen(line)>4000 AS truncated, sha256(CASE WHEN strlen(line)<=4000 THEN line ELSE left(line, list_max(list_filter(range(1000, 4001), lambda k: strlen(left(line, CAST(k AS BIGINT)))<=4000))) END) AS digest FROM sym""",
    also="q13_source_window_whole",
)
def q13(spark, d):
    spans = inputs.sym(spark, d).select("id", "path", F.col("start").alias("lo"), F.col("end").alias("hi"))
    rows = documents.source_windows(spans, inputs.cat(spark, d).select("path", "text"), 4000)
    return rows.select("id", "w_start", "start_line", "truncated", F.sha2("window", 256).alias("digest"))


@query("q15_leading_comment", "SELECT doc_id, CASE WHEN doc_id%3=0 AND NOT contains(split_part(text,chr(10),1),'*/') THEN trim(split_part(text,chr(10),1)) WHEN doc_id%3=1 THEN trim(split_part(text,chr(10),1)) END AS comment FROM documents")
def q15(spark, d):
    first = F.substring_index("text", "\n", 1)
    k = F.col("doc_id") % 3
    before = F.when(k == 0, F.concat(F.lit("x\n/* "), first, F.lit(" */\n"))).when(k == 1, F.concat(F.lit("x;\n// "), first, F.lit("\n"))).otherwise(F.concat(F.lit("x = "), first, F.lit(";\n")))
    return table(spark, d, "documents").select("doc_id", documents.leading_comment(before).alias("comment"))


@query("q16_line_of_byte", using("cat", "sym") + " SELECT id, i+1 AS line_no FROM sym", also="q16_line_of_byte_whole")
def q16(spark, d):
    spans = inputs.sym(spark, d).select("id", "path", F.col("start").alias("at"))
    return documents.line_numbers(spans, inputs.cat(spark, d).select("path", "text")).select("id", "line_no")


@query("q18_readme_excerpt", using("cat", "sym") + ", r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, line FROM sym WHERE trim(line)<>'') SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS excerpt FROM r WHERE k<=12 GROUP BY doc_id")
def q18(spark, d):
    docs = table(spark, d, "documents").where("trim(text) <> ''")
    return docs.select("doc_id", F.sha2(documents.excerpt(F.col("text")), 256).alias("excerpt"))


@query(
    "q19_budgeted_gather",
    using("cat", "sym", recursive=True)
    + """, p AS (SELECT doc_id AS owner, i AS seq, "end"-"start" AS size, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM sym),
 g AS (SELECT owner, k, total, CASE WHEN size<=1500 THEN size ELSE 0 END AS used, CASE WHEN size<=1500 THEN 1 ELSE 0 END AS n, CASE WHEN size<=1500 THEN CAST(seq AS VARCHAR) ELSE '' END AS seqs FROM p WHERE k=1
 UNION ALL SELECT g.owner, p.k, g.total, CASE WHEN g.used+p.size<=1500 THEN g.used+p.size ELSE g.used END, CASE WHEN g.used+p.size<=1500 THEN g.n+1 ELSE g.n END, CASE WHEN g.used+p.size<=1500 THEN g.seqs||CASE WHEN g.seqs='' THEN '' ELSE ',' END||p.seq ELSE g.seqs END FROM g JOIN p ON p.owner=g.owner AND p.k=g.k+1)
 SELECT owner, CAST(used AS BIGINT) AS used, CAST(n AS BIGINT) AS admitted, n<total AS truncated, seqs FROM g WHERE k=total""",
)
def q19(spark, d):
    pieces = inputs.sym(spark, d).select(F.col("doc_id").alias("owner"), F.col("i").alias("seq"), (F.col("end") - F.col("start")).alias("size"))
    return documents.gather(pieces, 1500)


@query("q21_run_markers", "SELECT event_id, user_id, event_type AS verdict, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id LIMIT 64")
def q21(spark, d):
    e = table(spark, d, "events")
    return e.orderBy(F.desc("ts"), "event_id").limit(64).select("event_id", "user_id", F.col("event_type").alias("verdict"), epoch_us(F.col("ts")).alias("at"))


@query("q22_newest_per_owner", using("queue") + " SELECT owner, id, place FROM (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, id) AS place FROM q) WHERE place<=3")
def q22(spark, d):
    return search.latest(projections.queue(spark, d), ["owner"], [F.desc("created_at"), F.asc("id")], 3).select("owner", "id", "place")


@query("q23_last_state", "SELECT user_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k=1")
def q23(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_type", "props")

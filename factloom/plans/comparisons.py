"""X: comparing two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.identity import anchor, digest
from factloom.operators import queue, versions
from factloom.plans import inputs
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.sources import projections
from factloom.sources.tables import table

V = using("cat", "versions")


def ab(spark, d):
    return projections.versions(inputs.cat(spark, d))


def file_nodes(v):
    return v.select(F.lit("file").alias("kind"), "path", F.lit("f").alias("name"), F.lit(0).alias("start"), F.col("bytes").alias("end"), "blob")


@query("x1_graph_diff", V + " SELECT coalesce(a.path,b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change, a.blob IS DISTINCT FROM b.blob AS bytes_changed FROM va a FULL JOIN vb b ON a.path=b.path WHERE a.path IS NULL OR b.path IS NULL OR a.bytes<>b.bytes")
def x1(spark, d):
    a, b = ab(spark, d)
    return versions.node_diff(file_nodes(a), file_nodes(b)).select("path", "change", "bytes_changed")


@query("x1_edge_diff", V + ", ea AS (SELECT doc_id%7 AS k, path, count(*) AS n FROM va GROUP BY 1,2), eb AS (SELECT doc_id%7 AS k, path, count(*) AS n FROM vb GROUP BY 1,2) SELECT coalesce(ea.k,eb.k) AS k, coalesce(ea.path,eb.path) AS path, coalesce(eb.n,0)-coalesce(ea.n,0) AS delta, CASE WHEN eb.n IS NULL THEN 'removed' ELSE 'added' END AS change FROM ea FULL JOIN eb ON ea.k=eb.k AND ea.path=eb.path WHERE coalesce(eb.n,0)<>coalesce(ea.n,0)")
def x1_edges(spark, d):
    a, b = (v.select((F.col("doc_id") % 7).alias("k"), "path") for v in ab(spark, d))
    return versions.edge_diff(a, b, ["k", "path"])


@query(
    "x2_relocate",
    V
    + """, n AS (SELECT doc_id, path AS to_path, 'doc_'||doc_id%500 AS to_name, blob AS to_blob FROM vb), o AS (SELECT doc_id, path, 'doc_'||doc_id%500 AS name, blob FROM va),
 p AS (SELECT o.doc_id AS id, o.path=to_path AND name=to_name AS exact, blob=to_blob AS same, name=to_name AS named, n.doc_id AS to_id FROM o JOIN n ON name=to_name OR o.path=to_path),
 g AS (SELECT id, count(*) FILTER (exact) AS ne, min(to_id) FILTER (exact) AS e, count(*) FILTER (same) AS ns, min(to_id) FILTER (same) AS s, count(*) FILTER (named) AS nn, min(to_id) FILTER (named) AS nm, count(*) AS c FROM p GROUP BY id),
 r AS (SELECT o.doc_id AS id, o.blob, CASE WHEN ne=1 THEN 'path_and_name' WHEN ns=1 THEN 'same_bytes' WHEN nn=1 THEN 'name' WHEN c>0 THEN 'ambiguous' ELSE 'no_counterpart' END AS rule, CASE WHEN ne=1 THEN e WHEN ns=1 THEN s WHEN nn=1 THEN nm END AS to_id, coalesce(c,0) AS candidates FROM o LEFT JOIN g ON g.id=o.doc_id)
 SELECT r.id, rule, r.to_id, candidates, r.blob<>n.to_blob AS bytes_changed FROM r LEFT JOIN n ON n.doc_id=r.to_id""",
)
def x2(spark, d):
    a, b = (v.select(F.col("doc_id").alias("id"), "path", F.concat(F.lit("doc_"), (F.col("doc_id") % 500).cast("string")).alias("name"), "blob") for v in ab(spark, d))
    return versions.relocate(a, b)


@query("x3_entity_digests", using("cat", "sym") + " SELECT id, sha256(line) AS digest FROM sym")
def x3(spark, d):
    return inputs.sym(spark, d).select("id", F.sha2("line", 256).alias("digest"))


@query("x4_run_keys", using("cat") + " SELECT path, sha256('bundle-1'||chr(0)||path||chr(0)||blob) AS run_key FROM cat")
def x4(spark, d):
    return inputs.cat(spark, d).select("path", digest(F.lit("bundle-1"), "path", "blob").alias("run_key"))


@query("x5_content_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents")
def x5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


KEYED = V + """, n AS (SELECT count(*) AS n FROM documents), dep0 AS (SELECT doc_id, (doc_id*7+3)%(SELECT n FROM n) AS dep FROM vb), ha AS (SELECT doc_id, blob AS hash FROM va), hb AS (SELECT doc_id, blob AS hash FROM vb),
 ka AS (SELECT h.doc_id, h.hash, sha256(h.hash||chr(0)||coalesce(t.hash,'')) AS key FROM ha h LEFT JOIN ha t ON t.doc_id=(h.doc_id*7+3)%(SELECT n FROM n)),
 kb AS (SELECT h.doc_id, h.hash, sha256(h.hash||chr(0)||coalesce(t.hash,'')) AS key FROM hb h LEFT JOIN hb t ON t.doc_id=(h.doc_id*7+3)%(SELECT n FROM n)),
 j AS (SELECT kb.doc_id, CASE WHEN ka.key IS NULL THEN 'new' WHEN ka.hash<>kb.hash THEN 'own_content' WHEN ka.key<>kb.key THEN 'dependency' ELSE 'reusable' END AS verdict, ka.key IS NULL OR ka.key<>kb.key AS moved FROM kb LEFT JOIN ka USING (doc_id))"""


def keyed(spark, d):
    """(before, now, deps): keys made of a file's hash and that of its one import."""
    n = table(spark, d, "documents").count()
    dep = (F.col("doc_id") * 7 + 3) % n
    a, b = ab(spark, d)

    def keys(v):
        to = v.select(F.col("doc_id").alias("dep"), F.col("blob").alias("dep_hash"))
        rows = v.withColumn("dep", dep).join(to, "dep", "left")
        return rows.select(F.col("doc_id").alias("path"), digest("blob", F.coalesce("dep_hash", F.lit(""))).alias("key"), F.col("blob").alias("hash"))

    return keys(a), keys(b), b.select(F.col("doc_id").alias("path"), dep.alias("dep"))


@query("x6_change_verdicts", KEYED + " SELECT j.doc_id AS path, j.verdict, CASE WHEN j.verdict='dependency' THEN coalesce(CAST(m.doc_id AS VARCHAR),'') END AS via FROM j LEFT JOIN j m ON m.moved AND m.doc_id=(j.doc_id*7+3)%(SELECT n FROM n)")
def x6(spark, d):
    return versions.verdicts(*keyed(spark, d))


@query("x7_withdrawn", V + " SELECT path FROM va WHERE path NOT IN (SELECT path FROM vb)")
def x7(spark, d):
    return versions.withdrawn(*ab(spark, d))


@query("x8_run_reuse", using("cat", "versions") + ", k AS (SELECT path, sha256(path||chr(0)||blob) AS key FROM vb), r AS (SELECT sha256(path||chr(0)||blob) AS key FROM va) SELECT path, key IN (SELECT key FROM r) AS reused FROM k")
def x8(spark, d):
    a, b = ab(spark, d)
    done = a.select(digest("path", "blob").alias("key"), F.lit(True).alias("hit")).dropDuplicates(["key"])
    rows = b.select("path", digest("path", "blob").alias("key")).join(done, "key", "left")
    return rows.select("path", F.coalesce("hit", F.lit(False)).alias("reused"))


@query("x9_selection_staleness", V + " SELECT a.path, CASE WHEN b.path IS NULL THEN 'gone' WHEN a.blob<>b.blob THEN 'stale' ELSE 'fresh' END AS status, sha256('file:'||a.path||chr(0)||a.blob) AS pin FROM va a LEFT JOIN vb b USING (path)")
def x9(spark, d):
    a, b = ab(spark, d)
    now = b.select("path", F.col("blob").alias("now"))
    status = F.when(F.col("now").isNull(), "gone").when(F.col("blob") != F.col("now"), "stale").otherwise("fresh")
    return a.join(now, "path", "left").select("path", status.alias("status"), digest(F.concat(F.lit("file:"), "path"), "blob").alias("pin"))


@query("x13_patched_snapshot", using("cat") + " SELECT path, sha256(CASE WHEN doc_id%9=2 THEN 'patched '||doc_id ELSE text END) AS blob, doc_id%9=2 AS overridden FROM cat WHERE doc_id%9<>1")
def x13(spark, d):
    cat = inputs.cat(spark, d)
    over = cat.where("doc_id % 9 = 2").select("path", F.concat(F.lit("patched "), F.col("doc_id").cast("string")).alias("text"))
    rows = versions.patched(cat.select("path", "text"), over, cat.where("doc_id % 9 = 1").select("path"))
    return rows.select("path", F.sha2("text", 256).alias("blob"), "overridden")


LIFE = """, ev AS (SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'view' THEN 'verify' WHEN 'click' THEN 'apply' WHEN 'purchase' THEN 'revert' WHEN 'error' THEN 'reject' ELSE 'noop' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT id, CAST(0 AS BIGINT) AS k, 'proposed' AS state, CAST(0 AS BIGINT) AS refused FROM (SELECT DISTINCT id FROM ev)
 UNION ALL SELECT f.id, e.k, CASE WHEN f.state='proposed' AND action='verify' THEN 'verified' WHEN f.state IN ('proposed','verified') AND action='reject' THEN 'rejected' WHEN f.state='verified' AND action='apply' THEN 'applied' WHEN f.state='applied' AND action='revert' THEN 'reverted' ELSE f.state END,
 f.refused + CASE WHEN (f.state='proposed' AND action='verify') OR (f.state IN ('proposed','verified') AND action='reject') OR (f.state='verified' AND action='apply') OR (f.state='applied' AND action='revert') THEN 0 ELSE 1 END FROM f JOIN ev e ON e.id=f.id AND e.k=f.k+1)
 SELECT id, state, refused FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC)=1"""


@query("x15_proposal_lifecycle", "WITH RECURSIVE one AS (SELECT 1)" + LIFE)
def x15(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_type")
    action = F.when(k == "view", "verify").when(k == "click", "apply").when(k == "purchase", "revert").when(k == "error", "reject").otherwise("noop")
    return queue.lifecycle(e.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), action.alias("action")))


@query("n5_anchors", using("cat", "dirs", "sym", "nodes") + " SELECT id, CASE kind WHEN 'function' THEN 'symbol:'||path||':'||name WHEN 'directory' THEN 'dir:'||path ELSE 'file:'||path END AS anchor FROM nodes")
def n5(spark, d):
    return inputs.nodes(spark, d).select("id", anchor(F.col("kind"), F.col("path"), F.col("name")).alias("anchor"))


@query("d13_compare_runs", V + " SELECT coalesce(a.doc_id,b.doc_id) AS case_id, CASE WHEN a.doc_id IS NULL THEN 'only_patched' WHEN b.doc_id IS NULL THEN 'only_base' WHEN a.blob=b.blob THEN 'same' ELSE 'differs' END AS outcome FROM va a FULL JOIN vb b ON a.doc_id=b.doc_id")
def d13(spark, d):
    a, b = ab(spark, d)
    rows = a.select("doc_id", F.col("blob").alias("x")).join(b.select("doc_id", F.col("blob").alias("y")), "doc_id", "full")
    out = F.when(F.col("x").isNull(), "only_patched").when(F.col("y").isNull(), "only_base").when(F.col("x") == F.col("y"), "same").otherwise("differs")
    return rows.select(F.col("doc_id").alias("case_id"), out.alias("outcome"))


@query("s12_set_operations", V + " SELECT 'both' AS part, count(*) AS n FROM (SELECT path FROM va INTERSECT SELECT path FROM vb) UNION ALL SELECT 'removed', count(*) FROM (SELECT path FROM va EXCEPT SELECT path FROM vb) UNION ALL SELECT 'added', count(*) FROM (SELECT path FROM vb EXCEPT SELECT path FROM va)")
def set_operations(spark, d):
    a, b = (v.select("path") for v in ab(spark, d))
    n = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n("both", a.intersect(b)).unionByName(n("removed", a.subtract(b))).unionByName(n("added", b.subtract(a)))

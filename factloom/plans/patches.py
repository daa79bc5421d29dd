"""Unified diffs between the two versions; V10, V11, V13, S6: validation; N4: persisted results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import catalog, dataflow, patch, queue, search
from factloom.plans import inputs
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.session import buckets, checkpointed, dealt, in_place
from factloom.sources import projections
from factloom.sources.tables import table

#: By doc_id mod 10: 0 is created, 1 deleted, 2 edited at its end; 4 names a line that is not there, 5 renames, 6 has headers that disagree.
KINDS = "doc_id%10 IN (0, 1, 2, 4, 5, 6)"
LINES = (
    using("cat")
    + """, l AS (SELECT doc_id, path, string_split(text, chr(10)) AS t FROM cat),
dl AS (SELECT CAST(doc_id AS VARCHAR) AS patch, path, 'modify' AS op, 1 AS hunk, 0 AS seq, len(t) AS old_start, ' ' AS kind, t[-1] AS line, NULL AS problem FROM l WHERE doc_id%10=2
 UNION ALL SELECT CAST(doc_id AS VARCHAR), path, 'modify', 1, 1, len(t), '+', 'edited', NULL FROM l WHERE doc_id%10=2
 UNION ALL SELECT CAST(doc_id AS VARCHAR), path, CASE doc_id%10 WHEN 0 THEN 'create' ELSE 'delete' END, 1, unnest(range(len(t))), 1, CASE doc_id%10 WHEN 0 THEN '+' ELSE '-' END, unnest(t), NULL FROM l WHERE doc_id%10 IN (0, 1)
 UNION ALL SELECT CAST(doc_id AS VARCHAR), path, 'modify', 1, 0, 1, '-', t[1]||'x', NULL FROM l WHERE doc_id%10=4
 UNION ALL SELECT CAST(doc_id AS VARCHAR), path, 'modify', 1, 1, 1, '+', 'new', NULL FROM l WHERE doc_id%10=4
 UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, 0, 0, 0, '', '', 'rename_refused' FROM l WHERE doc_id%10=5
 UNION ALL SELECT CAST(doc_id AS VARCHAR), path, 'modify', 0, 0, 0, '', '', 'headers_disagree' FROM l WHERE doc_id%10=6)"""
)


def diffs(spark, d):
    """(patch, text): a unified diff for every document of KINDS."""
    c = inputs.cat(spark, d).where(KINDS).select("doc_id", "path", F.split("text", "\n", -1).alias("t"))
    n, k = F.size("t").cast("string"), F.col("doc_id") % 10
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    path, signed = F.col("path"), lambda sign: F.array_join(F.transform("t", lambda x: F.concat(F.lit(sign), x)), "\n")
    old, new = text("--- a/", path, "\n"), text("+++ b/", path, "\n")
    diff = (
        F.when(k == 0, text("--- /dev/null\n", new, "@@ -0,0 +1,", n, " @@\n", signed("+"), "\n"))
        .when(k == 1, text(old, "+++ /dev/null\n@@ -1,", n, " +0,0 @@\n", signed("-"), "\n"))
        .when(k == 2, text(old, new, "@@ -", n, ",1 +", n, ",2 @@\n ", F.element_at("t", -1), "\n+edited\n"))
        .when(k == 4, text(old, new, "@@ -1,1 +1,1 @@\n-", F.element_at("t", 1), "x\n+new\n\\ No newline at end of file\n"))
        .when(k == 5, text("rename from ", path, "\nrename to elsewhere\n"))
        .when(k == 6, text(old, "+++ b/elsewhere\n@@ -1,1 +1,1 @@\n-a\n+b\n"))
    )
    return c.select(F.col("doc_id").cast("string").alias("patch"), diff.alias("text"))


def before(spark, d):
    return projections.versions(inputs.cat(spark, d))[0].select("path", "text")


@query("x10_diff_lines", LINES + " SELECT * FROM dl")
def x10(spark, d):
    return patch.parse(diffs(spark, d))


@query("x12_diff_report", LINES + " SELECT patch, path, any_value(op) AS op, max(hunk) AS hunks, count(*) FILTER (kind='+') AS added, count(*) FILTER (kind='-') AS removed, max(problem) AS problem FROM dl GROUP BY patch, path")
def x12(spark, d):
    return patch.report(patch.parse(diffs(spark, d)))


@query(
    "x11_diff_apply",
    using("cat")
    + """ SELECT CAST(doc_id AS VARCHAR) AS patch, path, CASE doc_id%10 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'modify' END AS op, CASE WHEN doc_id%10=4 THEN 'context_mismatch' END AS problem, CASE doc_id%10 WHEN 0 THEN sha256(text||chr(10)) WHEN 2 THEN sha256(text||chr(10)||'edited') END AS digest FROM cat WHERE doc_id%10 IN (0, 1, 2, 4)""",
)
def x11(spark, d):
    made = patch.apply(checkpointed(patch.parse(diffs(spark, d))), before(spark, d))
    return made.select("patch", "path", "op", "problem", F.sha2("text", 256).alias("digest"))


@query(
    "x14_verified_change",
    using("cat") + """ SELECT 'file' AS kind, path, regexp_extract(path,'[^/]*$') AS name, CASE doc_id%10 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'changed' END AS change, true AS bytes_changed FROM cat WHERE doc_id%10 IN (0, 1, 2)""",
)
def x14(spark, d):
    """Patches applied to a copy, the copy read again, and what changed against the version that they were made for."""
    files = before(spark, d)
    return patch.verify(checkpointed(patch.apply(checkpointed(patch.parse(diffs(spark, d))), files)), files)


@query(
    "x17_proposal_entity",
    using("cat")
    + """, p AS (SELECT doc_id, path, CASE WHEN doc_id%20=10 THEN 'file:elsewhere' WHEN doc_id%10=2 AND doc_id%3=0 THEN path||'.none' WHEN doc_id%2=0 THEN 'file:'||path ELSE path END AS reference FROM cat WHERE doc_id%10 IN (0, 1, 2, 4, 5, 6))
 SELECT CAST(doc_id AS VARCHAR) AS patch, CASE WHEN reference IN (path, 'file:'||path) THEN 'file:'||path END AS entity, doc_id%20=0 AS creates FROM p""",
)
def x17(spark, d):
    c = inputs.cat(spark, d).where(KINDS).select("doc_id", "path")
    k = F.col("doc_id") % 10
    reference = F.when(F.col("doc_id") % 20 == 10, "file:elsewhere").when((k == 2) & (F.col("doc_id") % 3 == 0), F.concat("path", F.lit(".none"))).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("file:"), "path")).otherwise(F.col("path"))
    proposals = c.select(F.col("doc_id").cast("string").alias("patch"), reference.alias("reference"))
    entities = before(spark, d).select(F.concat(F.lit("file:"), "path").alias("id"), "path")
    return patch.proposal_entity(proposals, entities, patch.parse(diffs(spark, d)))


@query(
    "v10_flow_validation",
    """WITH ln AS (SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
 SELECT fn, k AS id, 'duplicate_binding' AS problem FROM ln WHERE fn%17=0 UNION ALL SELECT fn, k, 'binding_without_scope' FROM ln WHERE fn%11=0 UNION ALL SELECT fn, k, 'binding_without_scope' FROM ln WHERE fn%11=0 AND fn%17=0
 UNION ALL SELECT fn, k, 'scope_without_parent' FROM ln WHERE fn%13=0 AND k=2 UNION ALL SELECT fn, k, 'unknown_binding' FROM ln WHERE fn%7=0 AND k%5=0
 UNION ALL SELECT fn, NULL, 'binding_budget' FROM (SELECT fn, count(*)*CASE WHEN fn%17=0 THEN 2 ELSE 1 END AS n FROM ln GROUP BY fn) WHERE n>6 UNION ALL SELECT DISTINCT fn, NULL, 'flow_of_no_symbol' FROM ln WHERE fn%19=0 UNION ALL SELECT DISTINCT -fn-1, NULL, 'symbol_without_flow' FROM ln WHERE fn%23=0""",
)
def v10(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem")
    ln = dealt(rows.select(F.col("l_orderkey").alias("fn"), F.row_number().over(w).cast("long").alias("id")), buckets(spark, rows.count()), "fn")
    scopes = ln.select("fn", "id", F.when(F.col("id") > 1, F.when((F.col("fn") % 13 == 0) & (F.col("id") == 2), F.lit(1000)).otherwise(F.col("id") - 1)).alias("parent"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fn") % 17 == 0, 2).otherwise(1)))
    bindings = ln.select("fn", "id", (F.col("id") + F.when(F.col("fn") % 11 == 0, 50).otherwise(0)).alias("scope"), times.alias("time")).drop("time")
    references = ln.select("fn", "id", F.when((F.col("fn") % 7 == 0) & (F.col("id") % 5 == 0), F.lit(1000)).otherwise(F.col("id")).alias("binding"))
    symbols = ln.where("fn % 19 <> 0").select("fn").distinct().unionByName(ln.where("fn % 23 = 0").select((-F.col("fn") - 1).alias("fn")).distinct())
    return in_place(dataflow.invalid_flow(bindings, scopes, references).unionByName(dataflow.invalid_cover(bindings, symbols, 6)))


@query(
    "s6_budgets",
    using("cat") + """ SELECT source, count(*) AS entries, sum(bytes)::BIGINT AS bytes, CASE WHEN count(*)>150 THEN 'entry_budget: '||count(*)||' entries, limit 150' WHEN sum(bytes)>300000 THEN 'byte_budget: '||sum(bytes)||' bytes, limit 300000' END AS refused FROM cat GROUP BY source""",
)
def s6(spark, d):
    return catalog.budget_report(inputs.cat(spark, d), ["source"], 150, 300_000)


@query(
    "v13_request_bounds",
    """WITH r AS (SELECT event_id AS id, event_id%620-10 AS page, CASE event_type WHEN 'error' THEN 'nothing' WHEN 'click' THEN 'function' ELSE 'file' END AS kind, event_id%530 AS nodes, event_id%2100 AS edges FROM events)
 SELECT id, CASE WHEN page<1 OR page>500 THEN 'invalid_limit' WHEN kind='nothing' THEN 'invalid_kind' WHEN nodes<1 OR nodes>500 THEN 'invalid_node_budget' WHEN edges<1 OR edges>2000 THEN 'invalid_edge_budget' END AS problem FROM r""",
)
def v13(spark, d):
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "nothing").when(F.col("event_type") == "click", "function").otherwise("file")
    rows = table(spark, d, "events").select(e.alias("id"), (e % 620 - 10).alias("page"), kind.alias("kind"), (e % 530).alias("nodes"), (e % 2100).alias("edges"))
    return rows.select("id", search.request_problem(F.col("page"), F.col("kind"), F.col("nodes"), F.col("edges")).alias("problem"))


@query(
    "n4_results",
    """WITH e AS (SELECT user_id, event_type, event_id%2 AS side, min(event_id) AS id FROM events GROUP BY ALL), a AS (SELECT * FROM e WHERE side=0), b AS (SELECT * FROM e WHERE side=1)
 SELECT 'result' AS kind, user_id, event_type, coalesce(a.id, b.id) AS id FROM a FULL JOIN b USING (user_id, event_type) UNION ALL SELECT 'explanation', user_id, event_type, coalesce(b.id, a.id) FROM a FULL JOIN b USING (user_id, event_type)""",
)
def n4(spark, d):
    """A result is kept as it was first stored; an explanation is replaced by its next one."""
    keys = ["user_id", "event_type"]
    rows = table(spark, d, "events").groupBy(*keys, (F.col("event_id") % 2).alias("side")).agg(F.min("event_id").alias("id"))
    held, new = (rows.where(F.col("side") == s).select(*keys, "id") for s in (0, 1))
    kinds = [("result", queue.insert_or_ignore(held, new, keys)), ("explanation", queue.insert_or_ignore(new, held, keys))]
    first, second = (df.select(F.lit(k).alias("kind"), *keys, "id") for k, df in kinds)
    return first.unionByName(second)

"""S and V: catalog, content-addressed blobs, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import is_source, on_boundary, safe_path
from factloom.operators import catalog, graph, validate
from factloom.plans import inputs
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.session import checkpointed, shared_folder
from factloom.sources import projections, stores, trees
from factloom.sources.tables import table


@query("s1_catalog_with_directories", using("cat", "dirs") + " SELECT path, kind, disposition, bytes FROM cat UNION ALL SELECT path, 'directory', 'directory', 0 FROM dirs")
def s1(spark, d):
    return catalog.with_directories(inputs.cat(spark, d))


#: What the folder of s1_tree_scan holds: the projection's files, some below a directory that no scan enters, links beside some, two policies.
WRITTEN = """, w0 AS (SELECT doc_id, CASE WHEN doc_id%29=5 THEN 'node_modules/'||path ELSE path END AS path, coalesce(text, '') AS text, CAST(NULL AS VARCHAR) AS link FROM cat
 UNION ALL SELECT doc_id, path||'.link', '', 'doc_'||(doc_id-1) FROM cat WHERE doc_id%31=7
 UNION ALL SELECT -1, '.gitignore', '# images'||chr(10)||'*.png'||chr(10)||'/src1/de/'||chr(10), NULL UNION ALL SELECT -2, 'src3/.gitignore', '*.js'||chr(10)||'!doc_1*.js'||chr(10), NULL),
 w AS (SELECT * FROM w0 WHERE NOT starts_with(path, 'node_modules/') AND NOT path LIKE 'src1/de/%'),
 a AS (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM w0),
 d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path FROM a UNION SELECT '')"""


@query(
    "s1_tree_scan",
    using("cat")
    + WRITTEN
    + """, f AS (SELECT path, text, link, link IS NULL AND (path LIKE '%.png' AND NOT path LIKE 'src3/%.js' OR path LIKE 'src3/%.js' AND NOT contains(path, '/doc_1')) AS ignored FROM w)
 SELECT path, CASE WHEN link IS NULL THEN 'file' ELSE 'symlink' END AS kind, CASE WHEN link IS NOT NULL THEN 'symlink' WHEN ignored THEN 'ignored' WHEN strlen(text)>8000 THEN 'oversize' ELSE 'captured' END AS disposition,
  CAST(strlen(text) AS BIGINT) AS bytes, CASE WHEN link IS NULL AND NOT ignored AND strlen(text)<=8000 THEN sha256(text) END AS blob,
  CASE WHEN link IS NOT NULL THEN 'link_not_followed;target_hash:'||sha256(link) WHEN ignored THEN 'gitignore_boundary' WHEN strlen(text)>8000 THEN 'file_byte_limit' END AS detail FROM f
 UNION ALL SELECT path, 'directory', CASE WHEN path IN ('node_modules', 'src1/de') THEN 'ignored' ELSE 'directory' END, 0, NULL, CASE path WHEN 'node_modules' THEN 'builtin_or_store_boundary' WHEN 'src1/de' THEN 'gitignore_boundary' END
 FROM d WHERE NOT starts_with(path, 'node_modules/') AND NOT path LIKE 'src1/de/%'""",
)
def s1_tree(spark, d):
    """A folder of the projection's files, written by tasks and scanned."""
    root = written_tree(spark, d)
    return trees.scan(spark, root, projections.OVERSIZE)[0]


def written_tree(spark, d) -> str:
    cat = inputs.cat(spark, d)
    path = F.when(F.col("doc_id") % 29 == 5, F.concat(F.lit("node_modules/"), "path")).otherwise(F.col("path"))
    files = cat.select(path.alias("path"), "text", F.lit(None).cast("string").alias("link"))
    links = cat.where("doc_id % 31 = 7").select(F.concat("path", F.lit(".link")).alias("path"), F.lit("").alias("text"), F.concat(F.lit("doc_"), (F.col("doc_id") - 1).cast("string")).alias("link"))
    policies = spark.createDataFrame([(".gitignore", "# images\n*.png\n/src1/de/\n", None), ("src3/.gitignore", "*.js\n!doc_1*.js\n", None)], "path string, text string, link string")
    root = shared_folder(spark, "tree")
    trees.write_tree(files.unionByName(links).unionByName(policies), root)
    return root


@query("s3_source_filter", using("cat") + " SELECT path FROM cat WHERE regexp_matches(path, '\\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$')")
def s3(spark, d):
    return inputs.cat(spark, d).where(is_source(F.col("path"))).select("path")


@query(
    "s5_disposition",
    "SELECT doc_id, CASE WHEN doc_id%23=0 THEN 'directory' WHEN doc_id%17=0 THEN 'ignored' WHEN doc_id%19=0 THEN 'symlink' WHEN strlen(text)>2000 THEN 'oversize' ELSE 'captured' END AS disposition FROM documents",
)
def s5(spark, d):
    kind = F.when(F.col("doc_id") % 23 == 0, "directory").when(F.col("doc_id") % 19 == 0, "symlink").otherwise("file")
    rule = catalog.disposition(kind, F.octet_length("text"), F.col("doc_id") % 17 == 0, 2000)
    return table(spark, d, "documents").select("doc_id", rule.alias("disposition"))


PROFILE = using("cat") + """, b AS (SELECT left(sha256(path),4) AS bucket, sha256(string_agg(path||'='||blob, chr(10) ORDER BY path, blob)) AS digest FROM cat GROUP BY 1),
 s AS (SELECT sha256(string_agg(bucket||'='||digest, chr(10) ORDER BY bucket)) AS scan_profile FROM b)"""


@query("s7_scan_profile", PROFILE + " SELECT scan_profile FROM s")
def s7(spark, d):
    return catalog.scan_profile(inputs.cat(spark, d))


@query("s10_snapshot_id", PROFILE + " SELECT sha256('profile-1'||chr(0)||scan_profile) AS snapshot_id FROM s")
def s10(spark, d):
    return catalog.snapshot_id(inputs.cat(spark, d), "profile-1")


@query("s8_blob_store", using("cat") + " SELECT blob, min(path) AS path, count(*) AS n_files, max(bytes) AS bytes FROM cat GROUP BY blob")
def s8(spark, d):
    return catalog.blobs(inputs.cat(spark, d))


@query("s8_put_new_blobs", using("cat") + " SELECT DISTINCT blob, bytes FROM cat WHERE blob NOT IN (SELECT blob FROM cat WHERE doc_id%2=0)")
def s8_put(spark, d):
    cat = inputs.cat(spark, d)
    return catalog.put_blobs(cat.where("doc_id % 2 = 0"), cat).select("blob", "bytes")


@query("s9_blob_integrity", using("cat") + " SELECT path, blob FROM (SELECT path, blob, CASE WHEN doc_id%97=3 THEN text||'!' ELSE text END AS text FROM cat) WHERE sha256(text)<>blob")
def s9(spark, d):
    damaged = inputs.cat(spark, d).withColumn("text", F.when(F.col("doc_id") % 97 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return catalog.corrupt(damaged).select("path", "blob")


@query("s11_readable_sources", using("cat") + " SELECT path, bytes FROM cat WHERE disposition='captured' AND regexp_matches(path, '\\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$')")
def s11(spark, d):
    return catalog.readable_sources(inputs.cat(spark, d)).select("path", "bytes")


@query(
    "s12_published_version",
    using("cat", "dirs", "sym", "calls", "bad", "edges", "nodes")
    + """, all_edges AS (SELECT id, kind FROM calle UNION ALL SELECT 'contains:'||id, 'contains' FROM nodes WHERE parent IS NOT NULL)
 SELECT 'nodes' AS relation, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM all_edges GROUP BY kind
 UNION ALL SELECT 'published', 'nodes', (SELECT count(*) FROM nodes) UNION ALL SELECT 'published', 'edges', (SELECT count(*) FROM all_edges)""",
)
def s12(spark, d):
    """Nodes and edges published together under one id, and read back by it; the marker's own counts beside them."""
    base = shared_folder(spark, "versions")
    n = checkpointed(inputs.nodes(spark, d))
    edges = inputs.call_edges(spark, d).select("id", "kind").unionByName(graph.contains_edges(n).select("id", "kind"))
    stores.publish({"nodes": n, "edges": edges}, base, "v1")
    found = [stores.load(spark, base, "v1", r).groupBy(F.lit(r).alias("relation"), "kind").agg(F.count("*").alias("n")) for r in ("nodes", "edges")]
    told = stores.versions(spark, base).select(F.lit("published").alias("relation"), F.col("relation").alias("kind"), "n")
    return found[0].unionByName(found[1]).unionByName(told)


@query(
    "s13_metadata_counters",
    using("cat", "dirs", "sym", "calls", "bad", "edges", "nodes")
    + """ SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind='function') AS functions, (SELECT count(*) FROM nodes WHERE kind='file') AS files,
 (SELECT count(*) FROM calle)+(SELECT count(*) FROM nodes WHERE parent IS NOT NULL) AS edges, (SELECT count(*) FROM calle) AS calls, (SELECT count(*) FROM calle WHERE target IS NULL) AS unresolved_calls""",
)
def s13(spark, d):
    n = inputs.nodes(spark, d)
    return catalog.counters(n, inputs.call_edges(spark, d).unionByName(graph.contains_edges(n)))


@query("s14_point_read", using("cat", "dirs", "sym", "nodes") + """ SELECT id, path, name, kind, "start", "end" FROM nodes WHERE path='src1/en/doc_1.ts'""")
def s14(spark, d):
    return inputs.nodes(spark, d).where("path = 'src1/en/doc_1.ts'").select("id", "path", "name", "kind", "start", "end")


@query(
    "v2_coverage",
    using("cat")
    + """, ack AS (SELECT path FROM cat WHERE doc_id%31<>0 UNION ALL SELECT path FROM cat WHERE doc_id%41=0 AND doc_id%31<>0 UNION ALL SELECT 'invented/'||doc_id FROM documents WHERE doc_id%53=0)
 SELECT path, 'missing' AS problem FROM cat WHERE path NOT IN (SELECT path FROM ack) UNION ALL SELECT DISTINCT path, 'invented' FROM ack WHERE path NOT IN (SELECT path FROM cat) UNION ALL SELECT path, 'duplicate' FROM ack GROUP BY path HAVING count(*)>1""",
)
def v2(spark, d):
    cat = inputs.cat(spark, d)
    ack = cat.where("doc_id % 31 <> 0").select("path")
    ack = ack.unionByName(cat.where("doc_id % 41 = 0 AND doc_id % 31 <> 0").select("path"))
    ack = ack.unionByName(cat.where("doc_id % 53 = 0").select(F.concat(F.lit("invented/"), F.col("doc_id").cast("string")).alias("path")))
    return validate.coverage(cat, ack)


@query(
    "v1_contracts",
    "WITH f AS (SELECT event_id AS id, CASE WHEN event_id%11=0 THEN 'facts-0' ELSE 'facts-1' END AS s, CASE WHEN event_id%13=0 THEN 'other' ELSE 'snapshot' END AS n, CASE WHEN event_id%7<>0 THEN 'front-end-1' WHEN event_id%2=0 THEN event_type END AS p FROM events) SELECT id, CASE WHEN s<>'facts-1' OR n<>'snapshot' THEN 'language_contract_mismatch' WHEN p IS NULL OR p<>'front-end-1' THEN 'worker_producer_not_supported:got='||coalesce(p,'')||':expected=front-end-1' END AS problem FROM f",
)
def v1(spark, d):
    e = F.col("event_id")
    facts = table(spark, d, "events").select(
        e.alias("id"),
        F.when(e % 11 == 0, "facts-0").otherwise("facts-1").alias("schema"),
        F.when(e % 13 == 0, "other").otherwise("snapshot").alias("snapshot_id"),
        F.when(e % 7 != 0, "front-end-1").when(e % 2 == 0, F.col("event_type")).alias("producer"),
    )
    return facts.select("id", validate.contract("facts-1", "snapshot", "front-end-1").alias("problem"))


@query("v3_diagnostics_inside", using("cat", "bad") + " SELECT path FROM bad WHERE path NOT IN (SELECT path FROM cat WHERE disposition='captured')")
def v3(spark, d):
    return validate.outside(inputs.bad(spark, d).distinct(), inputs.cat(spark, d).where("disposition = 'captured'"))


@query(
    "v4_symbol_ids",
    using("cat", "sym")
    + """, s2 AS (SELECT CASE WHEN i%29=0 THEN id||'x' ELSE id END AS id, path, "start", "end" FROM sym UNION ALL SELECT id, path, "start", "end" FROM sym WHERE i=3)
 SELECT id, 'duplicate' AS problem FROM s2 GROUP BY id HAVING count(*)>1 UNION ALL SELECT id, 'formula' FROM s2 WHERE id<>'symbol:'||path||':'||"start"||':'||"end" """,
)
def v4(spark, d):
    s = inputs.sym(spark, d)
    broken = s.withColumn("id", F.when(F.col("i") % 29 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")))
    return validate.bad_symbols(broken.unionByName(s.where("i = 3")))


@query("v5_span_borders", "SELECT doc_id, CASE WHEN strlen(text)>7 THEN substr(hex(encode(text)),15,2) NOT BETWEEN '80' AND 'BF' ELSE strlen(text)=7 END AS ok FROM documents")
def v5(spark, d):
    return table(spark, d, "documents").select("doc_id", on_boundary(F.col("text"), F.lit(7)).alias("ok"))


@query(
    "v6_containment",
    using("cat", "sym")
    + """, outer_ AS (SELECT path, 'block:'||path||':'||(i//5) AS id, min("start") AS "start", max("end") AS "end" FROM sym GROUP BY path, i//5)
 SELECT s.id AS id, o.id AS outer_id FROM sym s JOIN outer_ o ON s.path=o.path AND o."start"<=s."start" AND s."end"<=o."end" AND o.id<>s.id""",
)
def v6(spark, d):
    s = inputs.sym(spark, d)
    block = s.groupBy("path", F.floor(F.col("i") / 5).alias("b")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    block = block.withColumn("id", F.concat_ws(":", F.lit("block"), "path", F.col("b").cast("string")))
    return graph.inside(block, s).select("id", "outer_id")


@query("v7_call_owners", using("cat", "sym", "calls") + """ SELECT c.id, s.id IS NOT NULL AND s."start"<=c."start" AND c."end"<=s."end" AND s.path=c.path AS ok FROM calls c LEFT JOIN (SELECT * FROM sym WHERE i%13<>0) s ON s.id=c.owner""")
def v7(spark, d):
    s = inputs.sym(spark, d)
    owner = s.where("i % 13 <> 0").select(F.col("id").alias("owner"), F.col("path").alias("o_path"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    c = projections.call_sites(s).join(owner, "owner", "left")
    ok = F.coalesce((F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end")) & (F.col("path") == F.col("o_path")), F.lit(False))
    return c.select("id", ok.alias("ok"))


@query("v8_import_endpoints", using("cat", "imports") + " SELECT id FROM imports WHERE target_doc IS NOT NULL AND target_doc NOT IN (SELECT doc_id FROM cat WHERE disposition='captured')")
def v8(spark, d):
    inside = inputs.cat(spark, d).where("disposition = 'captured'").select(F.col("doc_id").alias("target_doc"))
    return inputs.imports(spark, d).where("target_doc IS NOT NULL").join(inside, "target_doc", "left_anti").select("id")


@query(
    "v9_dangling_edges",
    using("cat", "sym", "calls", "bad", "edges")
    + """, n AS (SELECT id FROM sym WHERE i%10<>0), e AS (SELECT * FROM calle UNION ALL SELECT * FROM calle WHERE basis='ambiguous')
 SELECT id, 'source' AS problem FROM e WHERE source NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'target' FROM e WHERE target IS NOT NULL AND target NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'duplicate' FROM e GROUP BY id HAVING count(*)>1""",
)
def v9(spark, d):
    e = inputs.call_edges(spark, d)
    return graph.dangling(e.unionByName(e.where("basis = 'ambiguous'")), inputs.sym(spark, d).where("i % 10 <> 0"))


@query("v12_over_budget", using("cat", "sym") + """ SELECT path, min_by(id, "start") AS "first", max("end"-"start") AS largest, count(*) AS n FROM sym WHERE "end"-"start">700 GROUP BY path""")
def v12(spark, d):
    return validate.over_budget(inputs.sym(spark, d), 700)[0]


@query("v14_safe_paths", using("cat") + ", p AS (SELECT CASE doc_id%5 WHEN 0 THEN '/'||path WHEN 1 THEN replace(path,'/','//') WHEN 2 THEN '../'||path WHEN 3 THEN path||'/.' ELSE path END AS path FROM cat) SELECT path, NOT list_has_any(string_split(path,'/'), ['','.','..']) AS safe FROM p")
def v14(spark, d):
    k, p = F.col("doc_id") % 5, F.col("path")
    odd = F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.replace(p, F.lit("/"), F.lit("//"))).when(k == 2, F.concat(F.lit("../"), p)).when(k == 3, F.concat(p, F.lit("/."))).otherwise(p)
    rows = inputs.cat(spark, d).select(odd.alias("path"))
    return rows.select("path", safe_path(F.col("path")).alias("safe"))

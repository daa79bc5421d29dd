"""A and W: roll-ups, histograms, scale, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import graph, nested, rollup
from factloom.plans import inputs
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.sources import projections
from factloom.sources.tables import table

E = using("cat", "sym", "calls", "bad", "edges")
FACTS = ("files", "functions", "call_sites", "unresolved", "bytes")


@query("a1_coverage", using("cat") + " SELECT disposition, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM cat GROUP BY disposition")
def a1(spark, d):
    return inputs.cat(spark, d).groupBy("disposition").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("a2_functions_per_file", using("cat", "sym") + " SELECT path, count(*) AS n FROM sym GROUP BY path")
def a2(spark, d):
    return inputs.sym(spark, d).groupBy("path").agg(F.count("*").alias("n"))


HIER = E + """, pf AS (SELECT c.source AS district, c.path, count(r.id) AS functions, count(r.id) AS call_sites, count(*) FILTER (r.id IS NOT NULL AND r.basis<>'resolved') AS unresolved, max(c.bytes) AS bytes FROM cat c LEFT JOIN res r ON r.path=c.path GROUP BY c.source, c.path),
 h AS (SELECT district, path, count(*) AS files, sum(functions)::BIGINT AS functions, sum(call_sites)::BIGINT AS call_sites, sum(unresolved)::BIGINT AS unresolved, sum(bytes)::BIGINT AS bytes, grouping(district, path)::BIGINT AS level FROM pf GROUP BY ROLLUP (district, path))"""


def hierarchy(spark, d):
    r = inputs.resolved(spark, d).groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("basis") != "resolved").alias("u"))
    files = inputs.cat(spark, d).select(F.col("source").alias("district"), "path", "bytes").join(r, "path", "left").na.fill(0, ["n", "u"])
    return rollup.hierarchy(files, "district", "path", {"files": F.lit(1), "functions": F.col("n"), "call_sites": F.col("n"), "unresolved": F.col("u"), "bytes": F.col("bytes")})


@query("a4_hierarchy_rollup", HIER + " SELECT * FROM h")
def a4(spark, d):
    return hierarchy(spark, d)


@query("a5_level_invariants", HIER + " SELECT level, sum(files)::BIGINT AS files, sum(functions)::BIGINT AS functions, sum(call_sites)::BIGINT AS call_sites, sum(unresolved)::BIGINT AS unresolved, sum(bytes)::BIGINT AS bytes FROM h GROUP BY level")
def a5(spark, d):
    return rollup.level_sums(hierarchy(spark, d), list(FACTS))


def file_pairs(spark, d):
    e = inputs.call_edges(spark, d).where("target IS NOT NULL")
    to = inputs.sym(spark, d).select(F.col("id").alias("target"), F.col("path").alias("b"))
    return e.join(to, "target").select(F.col("path").alias("a"), "b")


@query("a6_cross_file_calls", E + ' SELECT path AS "from", found_path AS "to", count(*) AS n FROM (SELECT r.path, s.path AS found_path FROM res r JOIN sym s ON s.id=r.found WHERE basis=\'resolved\') WHERE path<>found_path GROUP BY 1,2')
def a6(spark, d):
    return graph.pair_counts(file_pairs(spark, d), "a", "b")


@query("a7_internal_calls", E + " SELECT count(*) AS total, count(*) FILTER (r.path=s.path) AS internal FROM res r JOIN sym s ON s.id=r.found WHERE basis='resolved'")
def a7(spark, d):
    return file_pairs(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("a") == F.col("b")).alias("internal"))


@query("a8_level_blocks", using("cat") + " SELECT source, path, k<=10 AS drawn FROM (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY bytes DESC, path) AS k FROM cat)")
def a8(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("bytes"), "path")
    return inputs.cat(spark, d).withColumn("k", F.row_number().over(w)).select("source", "path", (F.col("k") <= 10).alias("drawn"))


HEIGHT = "CASE WHEN {0}<=0 THEN 0.45 WHEN {0}<=8 THEN {0} ELSE least(80.0, 8+3*log2({0}/8.0)) END"
TIER = "CASE WHEN {0}<=0 THEN 'flat' WHEN {0}<=8 THEN 'linear' WHEN {0}<=20 THEN 'thin' WHEN {0}<=50 THEN 'group' ELSE 'compressed' END"
COUNTS = using("cat", "sym") + ", v AS (SELECT path, CAST(count(id) AS BIGINT) AS n FROM cat LEFT JOIN sym USING (path) GROUP BY path)"


def function_counts(spark, d):
    """Symbols of every file, and none."""
    per = inputs.sym(spark, d).groupBy("path").agg(F.count("*").alias("n"))
    return inputs.cat(spark, d).select("path").join(per, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "a9_scale_report",
    COUNTS
    + f", o AS (SELECT {HEIGHT.format('n')} AS h, row_number() OVER (ORDER BY n)-1 AS k, count(*) OVER () AS c FROM v WHERE n>0), m AS (SELECT max(h) AS m FROM o) SELECT (SELECT count(*) FROM v) AS files, (SELECT count(*) FROM v WHERE n=0) AS empty, CAST(round(1000*max(m)) AS BIGINT) AS max, CAST(round(1000*max(CASE WHEN k=(c-1)//2 THEN h END)) AS BIGINT) AS median, CAST(round(1000*max(CASE WHEN k=least(c*9//10,c-1) THEN h END)) AS BIGINT) AS p90, count(*) FILTER (h*100<m) AS under_1pct, count(*) FILTER (h*10<m) AS under_10pct, true AS monotone FROM o, m",
)
def a9(spark, d):
    return rollup.scale_report(function_counts(spark, d), "n")


@query("a10_tier_histogram", COUNTS + f" SELECT {TIER.format('n')} AS tier, count(*) AS n, max(n) AS largest FROM v GROUP BY 1")
def a10(spark, d):
    per = function_counts(spark, d).withColumnRenamed("n", "m")
    return per.groupBy(rollup.tier(F.col("m")).alias("tier")).agg(F.count("*").alias("n"), F.max("m").alias("largest"))


@query("a11_run_markers_by_block", "SELECT 'block '||(user_id%20) AS block, count(*) FILTER (event_type='error') AS failed, count(*) FILTER (event_type='purchase') AS passed, count(*) AS runs FROM events GROUP BY 1")
def a11(spark, d):
    block = F.concat(F.lit("block "), (F.col("user_id") % 20).cast("string"))
    k = F.col("event_type")
    return table(spark, d, "events").groupBy(block.alias("block")).agg(F.count_if(k == "error").alias("failed"), F.count_if(k == "purchase").alias("passed"), F.count("*").alias("runs"))


@query("a12_origin_histogram", "SELECT kind, count(*) AS n FROM (SELECT unnest(['param(0)', l_returnflag||'(1)', l_linestatus||'(2)']) AS o, split_part(o,'(',1) AS kind FROM lineitem) GROUP BY kind")
def a12(spark, d):
    origins = F.array(F.lit("param(0)"), F.concat("l_returnflag", F.lit("(1)")), F.concat("l_linestatus", F.lit("(2)")))
    rows = table(spark, d, "lineitem").select(F.explode(origins).alias("o"))
    return rows.groupBy(F.substring_index("o", "(", 1).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "a12_nested_origins",
    """WITH f AS (SELECT l_orderkey AS o, l_linenumber AS n, '"'||l_returnflag||'('||l_linenumber||')"' AS r, '"'||l_linestatus||'(0)"' AS s FROM lineitem),
 j AS (SELECT CASE n%4 WHEN 0 THEN '{"origin":'||r||'}' WHEN 1 THEN '{"args":[{"origin":'||r||',"of":[[{"origin":'||s||'}]]},{"name":"origin"}]}' WHEN 2 THEN '[{"effects":{"reads":[{"at":1,"origin":'||s||'}],"origin":'||r||'}}]' ELSE '{"origin":' END AS text FROM f)
 SELECT split_part(json_extract_string(t.value, '$'), '(', 1) AS kind, count(*) AS n FROM (SELECT text FROM j WHERE json_valid(text)) v, json_tree(v.text) t WHERE t.key='origin' GROUP BY 1""",
)
def a12_nested(spark, d):
    """Origins at any depth of facts whose shape is not known; every fourth is cut short and holds none."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    r, s, k = text('"', F.col("l_returnflag"), "(", F.col("l_linenumber").cast("string"), ')"'), text('"', F.col("l_linestatus"), '(0)"'), F.col("l_linenumber") % 4
    fact = (
        F.when(k == 0, text('{"origin":', r, "}"))
        .when(k == 1, text('{"args":[{"origin":', r, ',"of":[[{"origin":', s, '}]]},{"name":"origin"}]}'))
        .when(k == 2, text('[{"effects":{"reads":[{"at":1,"origin":', s, '}],"origin":', r, "}}]"))
        .otherwise(F.lit('{"origin":'))
    )
    found = nested.fields(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), fact.alias("text")), "origin")
    return found.groupBy(F.substring_index("value", "(", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("a13_value_merge", "SELECT l_orderkey//2 AS id, CASE WHEN count(DISTINCT l_quantity)>8 THEN '' ELSE string_agg(DISTINCT CAST(l_quantity::INT AS VARCHAR), ',' ORDER BY CAST(l_quantity::INT AS VARCHAR)) END AS constants, count(DISTINCT l_quantity)>8 AS overflow FROM lineitem GROUP BY 1", also="a13_value_merge_whole")
def a13(spark, d):
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 2).alias("id"), "l_quantity")
    return rollup.capped_unions(rows, ["id"], F.col("l_quantity").cast("int").cast("string"), rollup.CONSTANTS)


@query("a14_effect_join", "SELECT l_suppkey AS id, bool_or(l_quantity>49) AS writes, bool_or(l_discount>0.09) AS throws, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS targets FROM lineitem GROUP BY l_suppkey")
def a14(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.bool_or(F.col("l_quantity") > 49).alias("writes"), F.bool_or(F.col("l_discount") > 0.09).alias("throws"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("targets")
    )


@query("a15_init_lattice", "SELECT l_orderkey AS id, CASE WHEN min(l_linestatus)=max(l_linestatus) THEN min(l_linestatus) ELSE 'maybe' END AS init FROM lineitem GROUP BY l_orderkey")
def a15(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rollup.initialised(F.col("l_linestatus")).alias("init"))


@query("a16_change_counts", using("cat", "sym", "versions") + ", la AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS line FROM va), lb AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS line FROM vb), a AS (SELECT doc_id, line, count(*) AS n FROM la GROUP BY ALL), b AS (SELECT doc_id, line, count(*) AS n FROM lb GROUP BY ALL) SELECT coalesce(a.doc_id,b.doc_id) AS doc_id, sum(greatest(coalesce(b.n,0)-coalesce(a.n,0),0))::BIGINT AS added, sum(greatest(coalesce(a.n,0)-coalesce(b.n,0),0))::BIGINT AS removed FROM a FULL JOIN b ON a.doc_id=b.doc_id AND a.line=b.line GROUP BY 1")
def a16(spark, d):
    a, b = projections.versions(inputs.cat(spark, d))
    lines = lambda v, n: v.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("doc_id", F.sha2("line", 256).alias("line")).agg(F.count("*").alias(n))
    rows = lines(a, "na").join(lines(b, "nb"), ["doc_id", "line"], "full").na.fill(0, ["na", "nb"])
    return rows.groupBy("doc_id").agg(F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).alias("removed"))


@query("a18_incremental_report", using("cat", "versions") + " SELECT count(*) FILTER (a.path IS NULL) AS new, count(*) FILTER (a.blob<>b.blob) AS own, count(*) FILTER (a.blob=b.blob) AS reusable FROM vb b LEFT JOIN va a USING (path)")
def a18(spark, d):
    a, b = projections.versions(inputs.cat(spark, d))
    rows = b.join(a.select("path", F.col("blob").alias("old")), "path", "left")
    return rows.agg(F.count_if(F.col("old").isNull()).alias("new"), F.count_if(F.col("old") != F.col("blob")).alias("own"), F.count_if(F.col("old") == F.col("blob")).alias("reusable"))


@query("a19_verdict_histogram", "SELECT event_type AS verdict, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a19(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("verdict")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("w6_offset_carry", "SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)-25) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS carried FROM lineitem")
def w6(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("long") - 25).over(w).alias("carried"))


@query("w2_latest_run", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type='purchase') WHERE k=1")
def w2(spark, d):
    rows = table(spark, d, "events").where("event_type = 'purchase'")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))

"""The smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import decisions, documents, nested, rollup
from factloom.plans import inputs
from factloom.plans.registry import ORACLE_SQL, QUERIES, query
from factloom.plans.sql import using
from factloom.plans.summaries import COUNTS, HEIGHT, TIER, function_counts
from factloom.sources.tables import table


@query("d2_param_order", "SELECT l_orderkey AS fn, string_agg('p'||l_partkey, ',' ORDER BY l_suppkey*1000+l_linenumber, 'p'||l_partkey) AS params FROM lineitem GROUP BY l_orderkey")
def d2(spark, d):
    start = F.col("l_suppkey") * 1000 + F.col("l_linenumber")
    ids = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.lit("param"), start.cast("string"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    return decisions.param_order(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn"), ids.alias("id")))


def names(spark, d):
    """(uses, own): an order uses its parts' brands and binds those of its first three lines."""
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn"), "l_partkey", "l_linenumber").join(brands, "l_partkey")
    return li.select("fn", "name"), li.where("l_linenumber <= 3").select("fn", "name")


NAMES = "u AS (SELECT l_orderkey AS fn, p_brand AS name, l_linenumber AS k FROM lineitem JOIN part ON p_partkey=l_partkey), own AS (SELECT fn, name FROM u WHERE k<=3)"


@query("d3_external_names", f"WITH {NAMES}, known AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_partkey<=3) SELECT fn, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM u WHERE (fn,name) NOT IN (SELECT fn,name FROM own) AND name NOT IN (SELECT name FROM known) GROUP BY fn")
def d3(spark, d):
    uses, own = names(spark, d)
    return decisions.external_names(uses, own, table(spark, d, "part").where("p_partkey <= 3").select(F.col("p_brand").alias("name")).distinct())


@query("d4_captures", f"WITH {NAMES} SELECT DISTINCT u.fn, u.name FROM u JOIN own o ON o.fn=u.fn//2 AND o.name=u.name WHERE (u.fn,u.name) NOT IN (SELECT fn,name FROM own)")
def d4(spark, d):
    uses, own = names(spark, d)
    parents = uses.select("fn").distinct().withColumn("parent", F.floor(F.col("fn") / 2))
    return decisions.captures(uses, own, parents)


@query(
    "d6_run_specs",
    "WITH s AS (SELECT event_id AS id, (event_id%70)*1000 AS t, event_id%3*600000 AS o, event_id%20 AS a, event_id%4=0 AS x FROM events) SELECT id, concat_ws(',', CASE WHEN NOT t BETWEEN 1 AND 60000 THEN 'timeout' END, CASE WHEN NOT o BETWEEN 1 AND 1048576 THEN 'output' END, CASE WHEN a>16 THEN 'args' END, CASE WHEN x THEN 'grants' END) AS problems, sha256(t||chr(0)||o||chr(0)||a||chr(0)||CASE WHEN x THEN 'files,root' ELSE 'files' END) AS spec FROM s",
)
def d6(spark, d):
    e = F.col("event_id")
    grants = F.when(e % 4 == 0, F.array(F.lit("root"), F.lit("files"))).otherwise(F.array(F.lit("files")))
    specs = table(spark, d, "events").select(e.alias("id"), (e % 70 * 1000).alias("timeout_ms"), (e % 3 * 600_000).alias("output_bytes"), (e % 20).alias("args"), grants.alias("grants"))
    return decisions.spec_problems(specs)


D8 = """WITH v AS (SELECT l_orderkey AS fn, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS m FROM lineitem)
 SELECT fn, n, p, CASE p%9 WHEN 0 THEN 'null' WHEN 1 THEN CAST(s AS VARCHAR) WHEN 2 THEN '"'||m||'"' WHEN 3 THEN '{"kind":"undefined"}' WHEN 4 THEN '{"kind":"nan"}' WHEN 5 THEN '['||s||',{"kind":"infinity"},["'||m||'"]]'
 WHEN 6 THEN '{"a":'||s||',"b":{"c":{"kind":"negative_infinity"}}}' WHEN 7 THEN '{"kind":"promise"}' ELSE '{"a":'||s||'}' END AS value FROM v"""


@query("d8_decoded_values", D8)
def d8(spark, d):
    s, m, k = F.col("l_suppkey").cast("string"), F.col("l_returnflag"), F.col("l_partkey") % 9
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number, word = text('{"kind":"number","value":', s, "}"), text('{"kind":"string","value":"', m, '"}')
    encoded = (
        F.when(k == 0, '{"kind":"null"}')
        .when(k == 1, number)
        .when(k == 2, word)
        .when(k == 3, '{"kind":"undefined"}')
        .when(k == 4, '{"kind":"nan"}')
        .when(k == 5, text('{"kind":"array","items":[', number, ',{"kind":"infinity"},{"kind":"array","items":[', word, "]}]}"))
        .when(k == 6, text('{"kind":"object","entries":{"a":', number, ',"b":{"kind":"object","entries":{"c":{"kind":"negative_infinity"}}}}}'))
        .when(k == 7, '{"kind":"promise","of":1}')
        .otherwise(text('{"a":', s, "}"))
    )
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), encoded.alias("encoded"))
    return nested.untagged(rows, "encoded", "value").drop("encoded")


@query("d11_effect_journal", "SELECT user_id AS id, event_type AS effect, count(*) AS n FROM events WHERE event_id%3=0 GROUP BY ALL")
def d11(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "denied").otherwise("seen")
    rows = table(spark, d, "events").select("user_id", F.struct(kind.alias("kind"), F.col("event_type").alias("effect")).alias("e"))
    return decisions.effect_journal(rows.select(F.col("user_id").alias("id"), F.array("e").alias("events")))


@query("q20_prompts", "SELECT item_id AS owner, sha256('## piece 0'||chr(10)||text) AS prompt, CAST(strlen(text) AS BIGINT) AS bytes FROM benchmark WHERE strlen(text)<=250")
def q20(spark, d):
    b = table(spark, d, "benchmark")
    two = F.array(F.struct(F.lit(0).alias("seq"), F.col("text")), F.struct(F.lit(1).alias("seq"), F.repeat("text", F.lit(300)).alias("text")))
    pieces = b.select(F.col("item_id").alias("owner"), F.explode(two).alias("p")).select("owner", "p.seq", "p.text")
    return documents.prompt(pieces, 250).select("owner", F.sha2("prompt", 256).alias("prompt"), "bytes")


@query("q24_contract")
def q24(spark, d):
    """The registered queries as data."""
    return spark.createDataFrame([(n, (f.__doc__ or "").strip(), n in ORACLE_SQL) for n, f in sorted(QUERIES.items())], "name string, description string, has_sql boolean")


@query("a10_ruler", COUNTS + f", m AS (SELECT max(n) AS m FROM v), s AS (SELECT unnest([0,1,8,20,50])::BIGINT AS stop UNION SELECT m FROM m WHERE m>50) SELECT stop, CAST(round(1000*({HEIGHT.format('stop')})) AS BIGINT) AS height, {TIER.format('stop')} AS tier FROM s")
def a10_ruler(spark, d):
    return rollup.ruler(function_counts(spark, d), "n")

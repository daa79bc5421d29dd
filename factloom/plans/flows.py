"""F: dataflow on programs drawn from order lines (an order is a function, its lines are blocks); streams; ignore rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions.times import epoch_us
from factloom.operators import dataflow, ignore, traverse
from factloom.plans import inputs
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.session import checkpointed, new_place
from factloom.sources import language_facts, projections
from factloom.sources.tables import table
from factloom.streaming import jobs

PROGRAM = """ln AS (SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS block, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity::INT AS qty FROM lineitem),
bl AS (SELECT fn, block, block+1 AS succ FROM ln WHERE block<n UNION SELECT fn, block, block+2 FROM ln WHERE block%3=0 AND block+2<=n UNION SELECT fn, block, 1 FROM ln WHERE block=n AND fn%20=0),
de AS (SELECT fn, block, block%3 AS var, block AS def, CASE WHEN block%4<>0 THEN CAST(qty AS VARCHAR) END AS value, CASE WHEN block%4=0 THEN block END AS origin FROM ln WHERE block%2=0 OR block=1),
us AS (SELECT fn, block, (block+1)%3 AS var, block AS use FROM ln)"""
REACH = f"""WITH RECURSIVE {PROGRAM}, r AS (SELECT d.fn, b.succ AS block, d.var, d.def FROM de d JOIN bl b ON b.fn=d.fn AND b.block=d.block
 UNION SELECT r.fn, b.succ, r.var, r.def FROM r JOIN bl b ON b.fn=r.fn AND b.block=r.block LEFT JOIN de k ON k.fn=r.fn AND k.block=r.block AND k.var=r.var WHERE k.def IS NULL)"""


def of_programs(spark, d, solve):
    """``solve`` (blocks, defs, uses, rounds) over all orders: a use at the start of each block, a definition at the end of some."""
    rows = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey")
    ln = rows.select(
        F.col("l_orderkey").alias("fn"),
        F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("block"),
        F.count("*").over(w).alias("n"),
        F.col("l_quantity").cast("int").cast("string").alias("qty"),
    )
    return dataflow.by_function(ln, rows.count(), lambda part, rounds: solve(*program(part), rounds))


def program(ln):
    b = F.col("block")
    edge = lambda cond, to: F.when(cond, to.cast("long"))
    to = F.array(edge(b < F.col("n"), b + 1), edge((b % 3 == 0) & (b + 2 <= F.col("n")), b + 2), edge((b == F.col("n")) & (F.col("fn") % 20 == 0), F.lit(1)))
    blocks = ln.select("fn", "block", F.explode(F.array_distinct(F.array_compact(to))).alias("succ"))
    defs = ln.where((b % 2 == 0) | (b == 1)).select("fn", "block", F.lit(1).alias("idx"), (b % 3).alias("var"), b.alias("def"), F.when(b % 4 != 0, F.col("qty")).alias("value"), F.when(b % 4 == 0, b).alias("origin"))
    uses = ln.select("fn", "block", F.lit(0).alias("idx"), ((b + 1) % 3).alias("var"), b.alias("use"))
    return blocks, defs, uses


@query("f4_reaching_definitions", REACH + " SELECT fn, block, var, def FROM r", also="f4_reaching_definitions_whole")
def f4(spark, d):
    return of_programs(spark, d, lambda blocks, defs, _, rounds: dataflow.reaching(blocks, defs, rounds))


@query("f16_def_use", REACH + " SELECT u.fn, u.var, r.def, u.use FROM us u JOIN r ON r.fn=u.fn AND r.block=u.block AND r.var=u.var", also="f16_def_use_whole")
def f16(spark, d):
    return of_programs(spark, d, dataflow.def_use)


@query(
    "f7_use_values",
    REACH
    + """, ch AS (SELECT u.fn, u.var, r.def, u.use FROM us u JOIN r ON r.fn=u.fn AND r.block=u.block AND r.var=u.var),
 ba AS (SELECT ch.fn, ch.use, de.value, de.origin FROM ch JOIN de ON de.fn=ch.fn AND de.def=ch.def),
 v AS (SELECT fn, use, value FROM ba WHERE origin IS NULL UNION SELECT u.fn, u.use, 'unknown' FROM us u LEFT JOIN ch ON ch.fn=u.fn AND ch.use=u.use WHERE ch.def IS NULL UNION SELECT ba.fn, ba.use, v.value FROM v JOIN ba ON ba.fn=v.fn AND ba.origin=v.use)
 SELECT fn, use, CASE WHEN count(DISTINCT value) FILTER (value<>'unknown')>8 THEN '' ELSE coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (value<>'unknown'),'') END AS constants, count(DISTINCT value) FILTER (value<>'unknown')>8 AS overflow, bool_or(value='unknown') OR count(DISTINCT value) FILTER (value<>'unknown')>8 AS unknown FROM v GROUP BY fn, use""",
    also="f7_use_values_whole",
)
def f7(spark, d):
    return of_programs(spark, d, dataflow.values)


@query("f11_live_blocks", f"WITH RECURSIVE {PROGRAM}, e AS (SELECT * FROM bl WHERE NOT (block%3=0 AND succ=block+1)), r AS (SELECT DISTINCT fn, CAST(1 AS BIGINT) AS block FROM ln UNION SELECT r.fn, e.succ FROM r JOIN e ON e.fn=r.fn AND e.block=r.block) SELECT fn, block FROM r", also="f11_live_blocks_whole")
def f11(spark, d):
    def solve(blocks, _, uses, rounds):
        entries = uses.select("fn").distinct().withColumn("block", F.lit(1).cast("long"))
        return dataflow.live_blocks(blocks, entries, blocks.where("block % 3 = 0 AND succ = block + 1"), rounds)

    return of_programs(spark, d, solve)


@query("g12_loop_blocks", f"WITH {PROGRAM} SELECT CAST(fn AS VARCHAR) AS fn, block FROM ln WHERE fn%20=0", also="g12_loop_blocks_whole")
def g12(spark, d):
    found = of_programs(spark, d, lambda blocks, _, __, rounds: dataflow.loop_blocks(blocks, rounds))
    return found.select(F.col("fn").cast("string"), "block")


N = using("nations", recursive=True)


def nation_program(spark, d):
    """(functions, own effects, calls): nations call each other as orders go; some have effects, some calls are unresolved."""
    e = checkpointed(projections.nation_edges(spark, d))
    functions = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("fn"))
    own = functions.where("fn % 6 = 0").select("fn", F.lit("writes").alias("effect")).unionByName(functions.where("fn % 7 = 1").select("fn", F.lit("throws").alias("effect")))
    calls = e.select(F.col("a").alias("fn"), F.col("b").alias("callee")).unionByName(functions.where("fn % 10 = 3").select("fn", F.lit(None).cast("long").alias("callee")))
    return functions, own, calls


@query("f14_effects_through_calls", N + ", own AS (SELECT CAST(n_nationkey AS BIGINT) AS fn, 'writes' AS effect FROM nation WHERE n_nationkey%6=0 UNION SELECT n_nationkey, 'throws' FROM nation WHERE n_nationkey%7=1 UNION SELECT n_nationkey, 'unknown_call' FROM nation WHERE n_nationkey%10=3), r AS (SELECT fn, effect FROM own UNION SELECT ne.a, r.effect FROM r JOIN ne ON ne.b=r.fn) SELECT fn, effect FROM r")
def f14(spark, d):
    _, own, calls = nation_program(spark, d)
    return dataflow.effects(own, calls)


@query("f15_never_returns", N + ", r AS (SELECT CAST(n_nationkey AS BIGINT) AS fn FROM nation WHERE n_nationkey%8=5 UNION SELECT ne.a FROM r JOIN ne ON ne.b=r.fn WHERE ne.a%3=0) SELECT fn FROM r")
def f15(spark, d):
    functions, _, calls = nation_program(spark, d)
    return dataflow.never_returns(functions, functions.where("fn % 8 <> 5"), calls.where("fn % 3 = 0"))


@query(
    "f17_summary_status",
    N
    + """, tc AS (SELECT a, b FROM ne UNION SELECT tc.a, ne.b FROM tc JOIN ne ON ne.a=tc.b), u AS (SELECT CAST(n_nationkey AS BIGINT) AS fn FROM nation WHERE n_nationkey%10=3 UNION SELECT ne.a FROM u JOIN ne ON ne.b=u.fn)
 SELECT CAST(n_nationkey AS BIGINT) AS fn, CASE WHEN n_nationkey%12=11 THEN 'partial_budget' WHEN n_nationkey IN (SELECT a FROM tc WHERE a=b) AND n_nationkey IN (SELECT fn FROM u) THEN 'partial_recursion' ELSE 'complete' END AS status FROM nation""",
)
def f17(spark, d):
    functions, own, calls = nation_program(spark, d)
    found = dataflow.effects(own, calls)
    e = calls.where("callee IS NOT NULL").select(F.col("fn").alias("a"), F.col("callee").alias("b"))
    loops = traverse.strong_components(e, singletons=False).select(F.col("id").alias("fn"))
    return dataflow.summary_status(functions, found, loops, functions.where("fn % 12 = 11"))


@query(
    "s4_ignore_rules",
    using("cat") + " SELECT path, CASE WHEN path LIKE 'src3/%.js' THEN NOT path LIKE '%/doc\\_1%.js' ESCAPE '\\' ELSE (path LIKE '%.png' OR path LIKE 'src1/de/%') END AS ignored FROM cat",
    also="s4_ignore_rules_whole",
)
def s4(spark, d):
    policies = spark.createDataFrame([(".gitignore", "# images\n*.png\n/src1/de/\n"), ("src3/.gitignore", "*.js\n!doc_1*.js\n")], "path string, text string")
    paths = inputs.cat(spark, d).select("path")
    return ignore.ignored(paths, ignore.rules(policies))


def scripts(spark, d):
    """A script per document of the source projection, made of its symbols' names: what a front-end reads."""
    s = inputs.sym(spark, d).select("doc_id", "path", "i").join(inputs.cat(spark, d).where("doc_id % 6 < 2").select("path"), "path", "left_semi")
    line = F.concat(F.lit("function f"), F.col("doc_id").cast("string"), F.lit("_"), F.col("i").cast("string"), F.lit("() { return f"), F.col("doc_id").cast("string"), F.lit("_"), (F.col("i") + 1).cast("string"), F.lit("(); }"))
    rows = s.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))).alias("l"))
    return rows.select("path", F.array_join(F.transform("l", lambda x: x.t), "\n").alias("text"))


@query("s16_script_facts", using("cat", "sym") + ", s AS (SELECT s.doc_id, s.path, s.i FROM sym s JOIN cat c USING (path) WHERE c.doc_id%6<2) SELECT path, 'f'||doc_id||'_'||i AS owner, 'f'||doc_id||'_'||(i+1) AS label FROM s", also="s16_script_facts_whole")
def s16(spark, d):
    files = checkpointed(scripts(spark, d))
    owners = language_facts.functions(files).select(F.col("id").alias("owner"), F.col("name").alias("owner_name"))
    return language_facts.calls(files).join(owners, "owner").select("path", F.col("owner_name").alias("owner"), "label")


@query("w7_stream_outcomes", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_outcomes(spark, d):
    """The event stream, drained: one run of all that is there."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.drained(jobs.outcome_counts(rows), new_place(spark, "outcomes")).select(epoch_us(F.col("start").cast("timestamp_ntz")).alias("start"), "event_type", "n")

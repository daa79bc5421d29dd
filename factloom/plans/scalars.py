"""F and D: scalar semantics, profiles, decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions.identity import digest
from factloom.operators import dataflow, decisions, documents, folding
from factloom.plans import inputs
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.sources import projections
from factloom.sources.tables import table


def lines(spark, d):
    """All order lines as operands: a tagged left and right value and an operator."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    n = folding.value("num", num=F.col("l_quantity"))
    s = folding.value("str", text=F.col("l_returnflag"))
    m = F.col("l_partkey") % 5
    a = F.when(m == 0, s).when(m == 1, folding.value("null")).when(m == 2, folding.value("undefined")).when(m == 3, folding.value("bool", flag=F.col("l_linestatus") == "O")).otherwise(n)
    k = F.col("l_suppkey") % 4
    b = F.when(k == 0, folding.value("str", text=F.col("l_linestatus"))).when(k == 1, folding.value("num", num=F.col("l_linenumber"))).when(k == 2, folding.value("null")).otherwise(folding.value("bool", flag=F.col("l_returnflag") == "R"))
    return rows.withColumns({"a": a, "b": b})


ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
A_NUM = "CASE l_partkey%5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN (l_linestatus='O')::INT::DOUBLE ELSE l_quantity END"
B_NUM = "CASE l_suppkey%4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN l_linenumber WHEN 2 THEN 0.0 ELSE (l_returnflag='R')::INT::DOUBLE END"
A_TRUE = "CASE l_partkey%5 WHEN 0 THEN l_returnflag<>'' WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN l_linestatus='O' ELSE l_quantity<>0 END"
A_TEXT = "CASE l_partkey%5 WHEN 0 THEN l_returnflag WHEN 1 THEN 'null' WHEN 2 THEN 'undefined' WHEN 3 THEN CASE WHEN l_linestatus='O' THEN 'true' ELSE 'false' END ELSE CAST(l_quantity::BIGINT AS VARCHAR) END"
B_TEXT = "CASE l_suppkey%4 WHEN 0 THEN l_linestatus WHEN 1 THEN CAST(l_linenumber AS VARCHAR) WHEN 2 THEN 'null' ELSE CASE WHEN l_returnflag='R' THEN 'true' ELSE 'false' END END"


def shown_number(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 'NaN' ELSE CAST(({x})::BIGINT AS VARCHAR) END"


@query("f3_may_throw", "SELECT l_linenumber AS k, l_returnflag AS f, l_linestatus AS s, CASE l_linenumber%5 WHEN 0 THEN true WHEN 1 THEN l_returnflag<>'A' WHEN 2 THEN l_returnflag IN ('R') WHEN 3 THEN l_returnflag<>'N' ELSE false END AS may_throw, count(*) AS n FROM lineitem GROUP BY ALL")
def f3(spark, d):
    m = F.col("l_linenumber") % 5
    kind = F.when(m == 0, "call").when(m == 1, "property_read").when(m == 2, "unary").when(m == 3, "binary").otherwise("read")
    f = F.col("l_returnflag")
    detail = F.when((m == 1) & (f == "A"), "optional").when((m == 2) & (f == "R"), "~").when((m == 2), "!").when((m == 3) & (f == "N"), "===").otherwise("+")
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), f.alias("f"), F.col("l_linestatus").alias("s"), folding.may_throw(kind, detail).alias("may_throw"))
    return rows.groupBy("k", "f", "s", "may_throw").agg(F.count("*").alias("n"))


@query("f8_fold_arithmetic", f"SELECT {ROW}, {shown_number(f'({A_NUM})-({B_NUM})')} AS minus, {shown_number(f'({A_NUM})*({B_NUM})')} AS times FROM lineitem")
def f8(spark, d):
    fold = lambda op: folding.to_text(folding.binary(F.lit(op), F.col("a"), F.col("b")))
    return lines(spark, d).select(*ROW.split(", "), fold("-").alias("minus"), fold("*").alias("times"))


@query("f9_plus", f"SELECT {ROW}, CASE WHEN l_partkey%5=0 OR l_suppkey%4=0 THEN 'str:'||({A_TEXT})||({B_TEXT}) ELSE 'num:'||{shown_number(f'({A_NUM})+({B_NUM})')} END AS plus FROM lineitem")
def f9(spark, d):
    return lines(spark, d).select(*ROW.split(", "), folding.shown(folding.binary(F.lit("+"), F.col("a"), F.col("b"))).alias("plus"))


@query("f10_truth", f"SELECT {ROW}, {A_TRUE} AS truth, l_partkey%5 IN (1,2) AS nullish, CASE l_partkey%5 WHEN 0 THEN 'string' WHEN 1 THEN 'object' WHEN 2 THEN 'undefined' WHEN 3 THEN 'boolean' ELSE 'number' END AS kind, CASE WHEN l_partkey%5=0 AND l_suppkey%4=0 THEN l_returnflag=l_linestatus WHEN l_partkey%5=1 AND l_suppkey%4=2 THEN true WHEN l_partkey%5=3 AND l_suppkey%4=3 THEN (l_linestatus='O')=(l_returnflag='R') WHEN l_partkey%5=4 AND l_suppkey%4=1 THEN l_quantity=l_linenumber ELSE false END AS same FROM lineitem")
def f10(spark, d):
    a, b = F.col("a"), F.col("b")
    return lines(spark, d).select(
        *ROW.split(", "), folding.truthy(a).alias("truth"), folding.nullish(a).alias("nullish"), folding.unary(F.lit("typeof"), a).str.alias("kind"), folding.strictly_equal(a, b).alias("same")
    )


@query("f18_contexts", "SELECT callee, caller, op FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller, op) AS k FROM (SELECT CASE WHEN l_partkey%10<>0 THEN l_suppkey END AS callee, l_orderkey AS caller, l_linenumber AS op FROM lineitem WHERE l_returnflag<>'N') WHERE callee IS NOT NULL) WHERE k<=8")
def f18(spark, d):
    """An order calls its lines' suppliers, a tenth of them by names that are not resolved; returned lines pass scalars."""
    callee = F.when(F.col("l_partkey") % 10 != 0, F.col("l_suppkey"))
    calls = table(spark, d, "lineitem").select(callee.alias("callee"), F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("op"), (F.col("l_returnflag") != "N").alias("scalar"))
    return dataflow.contexts(calls).select("callee", F.col("fn").alias("caller"), "op")


FLAGS = "SELECT p_partkey AS id, p_partkey%11=0 AS u, p_partkey%7=0 AS nst, p_partkey%5=0 AS net, p_partkey%3=0 AS fil, p_partkey%2=0 AS mut FROM part"
PROFILE = f"""f AS ({FLAGS}), pr AS (SELECT id, CASE WHEN u THEN 'unsupported' WHEN nst THEN 'needs_entry_driver' WHEN net OR fil OR mut THEN 'needs_context' ELSE 'pure_callable' END AS class,
 concat_ws(',', CASE WHEN u THEN 'has_unknown' END, CASE WHEN nst THEN 'needs_entry' END, CASE WHEN net THEN 'reads_network' END, CASE WHEN fil THEN 'reads_files' END, CASE WHEN mut THEN 'mutates_captured' END) AS reasons,
 concat_ws(',', CASE WHEN mut THEN 'context' END, CASE WHEN fil THEN 'files' END, CASE WHEN net THEN 'network' END) AS grants, mut, fil, net FROM f)"""


def profiles(spark, d):
    k = F.col("p_partkey")
    flags = table(spark, d, "part").select(k.alias("id"), *[(k % m == 0).alias(c) for c, m in (("unknown", 11), ("is_nested", 7), ("network", 5), ("files", 3), ("mutates", 2))])
    return decisions.profile(flags)


@query("d1_execution_profile", f"WITH {PROFILE} SELECT id, class, reasons, grants FROM pr")
def d1(spark, d):
    return profiles(spark, d)


#: One in m order lines has each fact, by a number of the line.
H = "(l_partkey*7+l_suppkey*3+l_orderkey)"
D1 = f"""WITH h AS (SELECT l_orderkey AS fn, l_linenumber AS n, {H} AS h FROM lineitem),
 r AS (SELECT *, concat_ws(',', CASE WHEN h%11=0 OR h%53=1 THEN 'analysis_partial' END, CASE WHEN h%13=0 OR h%17=0 THEN 'unknown_region' END, CASE WHEN h%19=0 THEN 'frontier_blocks' END, CASE WHEN h%17=0 THEN 'dynamic_code' END,
 CASE WHEN h%23=0 THEN 'unknown_call' END, CASE WHEN h%29=0 THEN 'may_call' END, CASE WHEN h%31=0 THEN 'registers_callback' END, CASE WHEN h%37=0 THEN 'escaped_value' END, CASE WHEN h%3=0 THEN 'reads_global' END, CASE WHEN h%41=0 THEN 'heap_state' END,
 CASE WHEN h%5=3 THEN 'captured_binding' END, CASE WHEN h%14=5 THEN 'external_binding' END, CASE WHEN h%9=4 THEN 'receiver_this' END, CASE WHEN h%43=0 THEN 'callsite_incomplete' END) AS reasons FROM h),
 c AS (SELECT *, CASE WHEN contains(reasons,'dynamic_code') THEN 'unsupported' WHEN regexp_matches(reasons,'unknown_call|registers_callback|escaped_value|callsite_incomplete') THEN 'needs_entry_driver' WHEN reasons<>'' THEN 'needs_context' ELSE 'pure_callable' END AS class, h%5=3 AND h%2<>0 AS lost FROM r)
 SELECT fn||':'||n AS id, class, class IN ('pure_callable','needs_entry_driver') OR (class='needs_context' AND NOT lost) AS runnable, reasons,
 CASE WHEN regexp_matches(reasons,'analysis_partial|unknown_region|frontier_blocks|unknown_call|registers_callback|escaped_value|heap_state|callsite_incomplete') OR (h%3=0 AND h%6<>0) OR (h%5=3 AND h%2=0) THEN 'unknown_calls' ELSE '' END AS grants,
 concat_ws(',', CASE WHEN h%6=0 THEN 'globals' END, CASE WHEN h%9=4 THEN 'this_arg' END) AS context, CASE WHEN lost THEN 'captures' ELSE '' END AS unsatisfiable FROM c"""


@query("d1_fact_profile", D1)
def d1_facts(spark, d):
    h = F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_orderkey")
    one = lambda m, r=0: h % m == r
    number = lambda m, r=0: F.when(one(m, r), 2).otherwise(0)
    rows = table(spark, d, "lineitem").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.when(one(11), "partial").when(~one(53, 1), "complete_within_profile").alias("status"),
        F.array_compact(F.array(F.when(one(13), "loop_bound"), F.when(one(17), "uses_eval"))).alias("unknown_reasons"),
        *[number(*m).alias(c) for c, m in (("frontier", (19,)), ("may_call", (29,)), ("captures", (5, 3)), ("externals", (14, 5)), ("receivers", (9, 4)))],
        *[one(m).alias(c) for c, m in (("unknown_call", 23), ("registers_callback", 31), ("escaped", 37), ("reads_global", 3), ("heap", 41), ("incomplete_sites", 43), ("top_level", 2))],
        F.when(one(6), F.array(F.lit("console"))).alias("globals"),
    )
    return decisions.execution_profile(rows)


@query("d5_run_decision", f"WITH {PROFILE} SELECT id, CASE WHEN class='unsupported' THEN 'refused' WHEN fil OR net THEN 'needs_grants' WHEN class='needs_entry_driver' THEN 'via_entry' ELSE 'run' END AS decision, concat_ws(',', CASE WHEN fil THEN 'files' END, CASE WHEN net THEN 'network' END) AS missing FROM pr")
def d5(spark, d):
    return decisions.decide(profiles(spark, d), F.array(F.lit("context")))


CASES = """c AS (SELECT event_id AS id, CASE WHEN event_id%3=0 THEN event_type END AS expect_returns, CASE WHEN event_id%3=1 THEN 'Error' END AS expect_throws, event_id%5=0 AS expect_denied, CASE WHEN event_id%2=0 THEN event_type ELSE 'other' END AS returned, CASE WHEN event_id%7=1 THEN 'Error' END AS thrown, event_id%10=0 AS denied, event_id%97=0 AS refused FROM events),
 k AS (SELECT id, concat_ws(',', CASE WHEN expect_returns IS NOT NULL AND expect_returns<>returned THEN 'returns' END, CASE WHEN expect_throws IS NOT NULL AND thrown IS NULL THEN 'throws' END, CASE WHEN expect_throws IS NULL AND thrown IS NOT NULL THEN 'unexpected_throw' END, CASE WHEN expect_denied<>denied THEN 'denied' END) AS failures, refused FROM c),
 s AS (SELECT id, failures, CASE WHEN refused THEN 'refused' WHEN failures='' THEN 'passed' ELSE 'failed' END AS outcome FROM k)"""


def cases(spark, d):
    e, k = F.col("event_id"), F.col("event_type")
    rows = table(spark, d, "events").select(
        e.alias("id"),
        F.when(e % 3 == 0, k).alias("expect_returns"),
        F.when(e % 3 == 1, "Error").alias("expect_throws"),
        (e % 5 == 0).alias("expect_denied"),
        F.when(e % 2 == 0, k).otherwise("other").alias("returned"),
        F.when(e % 7 == 1, "Error").alias("thrown"),
        (e % 10 == 0).alias("denied"),
        (e % 97 == 0).alias("refused"),
    )
    return decisions.compare_case(rows)


@query("d7_scenario_cases", f"WITH {CASES} SELECT id, failures, outcome FROM s")
def d7(spark, d):
    return cases(spark, d)


@query("d9_scenario_counters", f"WITH {CASES} SELECT id//64 AS scenario, count(*) FILTER (outcome='passed') AS passed, count(*) FILTER (outcome='failed') AS failed, count(*) FILTER (outcome='refused') AS refused FROM s GROUP BY 1")
def d9(spark, d):
    o = F.col("outcome")
    return cases(spark, d).groupBy(F.floor(F.col("id") / 64).alias("scenario")).agg(*[F.count_if(o == x).alias(x) for x in ("passed", "failed", "refused")])


@query("d10_answer_identity", "SELECT event_id, sha256(user_id||chr(0)||event_type||chr(0)||props) AS answer FROM events")
def d10(spark, d):
    return table(spark, d, "events").select("event_id", digest("user_id", "event_type", "props").alias("answer"))


#: A frame for every symbol: as engines print them, with and without a name, some outside of the copy, some without a line.
FRAME = "CASE i%5 WHEN 0 THEN '    at f (file:///tmp/run/'||path||':'||(i+1)||':'||(i%9+1)||')' WHEN 1 THEN 'at /tmp/run/'||path||':'||(i+1)||':3' WHEN 2 THEN '  at g (/usr/lib/'||path||':1:1)' WHEN 3 THEN 'at h (file:///tmp/run/'||path||':'||(i+900000)||':1)' ELSE 'at native' END"


@query(
    "d12_frame_offsets",
    using("cat", "sym") + """ SELECT id, path, CASE WHEN i%5=3 THEN i+900000 ELSE i+1 END AS line, CASE i%5 WHEN 0 THEN i%9+1 WHEN 1 THEN 3 ELSE 1 END AS "column", CASE WHEN i%5=3 THEN bytes ELSE "start" END AS byte_offset, CASE WHEN i%5=3 THEN '' ELSE left(line, 200) END AS line_text FROM sym JOIN (SELECT path, bytes FROM cat) USING (path) WHERE i%5 IN (0, 1, 3)""",
    also="d12_frame_offsets_whole",
)
def d12(spark, d):
    frames = inputs.sym(spark, d).select("id", F.expr(FRAME).alias("frame"))
    return documents.frame_offsets(frames, inputs.cat(spark, d).select("path", "text"), "/tmp/run")


@query("d16_slice_manifest", using("cat", "imports", recursive=True) + ", e AS (SELECT i.path AS a, c.path AS b FROM imports i JOIN cat c ON c.doc_id=i.target_doc WHERE NOT type_only), r AS (SELECT path AS id FROM cat WHERE doc_id=1 UNION SELECT e.b FROM r JOIN e ON e.a=r.id), m AS (SELECT path, blob, row_number() OVER (ORDER BY path) AS k FROM cat WHERE path IN (SELECT id FROM r)) SELECT count(*) AS files, count(*) FILTER (k>512) AS skipped, sha256(string_agg(CASE WHEN k<=512 THEN path||'='||blob END, chr(10) ORDER BY path)) AS workdir_digest FROM m")
def d16(spark, d):
    from factloom.operators import traverse

    seed = inputs.cat(spark, d).where("doc_id = 1").select(F.col("path").alias("id"))
    files = traverse.import_closure(inputs.import_paths(spark, d), seed)[0].select(F.col("id").alias("path"))
    c = inputs.cat(spark, d).join(files, "path", "left_semi").select("path", "blob")
    first = c.orderBy("path").limit(512)
    total = c.agg(F.count("*").alias("files"))
    made = first.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "path", "blob"))), "\n"), 256).alias("workdir_digest"))
    return total.crossJoin(made).select("files", F.greatest(F.col("files") - 512, F.lit(0).cast("long")).alias("skipped"), "workdir_digest")


@query("d17_via_chain", "SELECT l_orderkey AS plan, bool_and(coalesce(l_partkey>prev, l_linenumber=1)) AS connected FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS prev FROM lineitem) GROUP BY l_orderkey")
def d17(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").withColumn("prev", F.lag("l_partkey").over(w))
    return rows.groupBy(F.col("l_orderkey").alias("plan")).agg(F.bool_and(F.coalesce(F.col("l_partkey") > F.col("prev"), F.col("l_linenumber") == 1)).alias("connected"))


@query("d18_first_body_wins", using("queue") + " SELECT owner, priority, id FROM (SELECT *, row_number() OVER (PARTITION BY owner, priority ORDER BY created_at, id) AS k FROM q) WHERE k=1")
def d18(spark, d):
    from factloom.operators.search import latest

    return latest(projections.queue(spark, d), ["owner", "priority"], [F.asc("created_at"), F.asc("id")], 1).select("owner", "priority", "id")

"""Row numbers by ranges, folds of a focus, requests and heartbeats, profiles of facts, decoded values, closures."""

import json

from pyspark.sql import functions as F

from factloom.operators import catalog, decisions, nested, queue, ranks, traverse, validate


def test_numbers_follow_the_order_over_all_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    got = {(r.g, r.v): r.k for r in ranks.numbered(rows, [F.desc("g"), F.col("v")], "k").collect()}
    want = sorted(got, key=lambda p: (-p[0], p[1]))
    assert [got[p] for p in want] == list(range(1, 1001))
    assert ranks.numbered(rows.where("v < 0"), [F.col("v")], "k").collect() == []


def test_folds_are_chains_tails_or_not_attributed(spark):
    levels = spark.createDataFrame([(0, 0, True), (1, 1, False), (2, 2, True), (3, 1, False), (4, 2, False), (9, 1, False)], "id long, distance int, drawn boolean")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 3), (3, 4), (0, None)], "a long, b long")
    got = sorted(map(tuple, traverse.folds(levels, edges).collect()), key=str)
    assert got == [("chain", 0, 2, 1, "1"), ("tail", 0, None, 2, "3,4"), ("unattributed", None, None, 1, "9")]
    assert traverse.folds(levels.where("drawn"), edges).collect() == []


def test_a_closure_names_what_a_copy_breaks(spark):
    files = spark.createDataFrame([("a.js",)], "id string")
    names = ["./x", "./x", "..", "../y", ".hidden", "pkg", "...", None]
    got = {tuple(r) for r in traverse.closure_report(files, spark.createDataFrame([(n,) for n in names], "specifier string"), 2).collect()}
    assert got == {("file", "a.js"), ("relative", ".."), ("relative", "../y"), ("bare", "3")}


def test_requests_are_bounded_and_idempotent(spark):
    rows = [("o", "k", "inspect", "a", 2, 1), ("o", "k", "execute", "a", 1, 2), ("o", "m", "inspect", "gone", 1, 3), ("o", "n", None, "a", 1, 4), ("p", "k", "annotate", "a", 5, 5), ("p", "k", "annotate", "a", 5, 5)]
    asked = queue.asked(spark.createDataFrame(rows, "owner string, request_key string, kind string, analysis string, created_at long, seq long"), spark.createDataFrame([("a",), ("a",)], "analysis string"))
    got = sorted(((r.kind, r.state, r.reason) for r in asked.collect()), key=str)
    assert got == [("annotate", "queued", None), ("execute", "rejected", "action_not_in_bounded_set"), ("inspect", "rejected", "unknown_analysis"), (None, "rejected", "action_not_in_bounded_set")]
    held = asked.withColumn("lease_expires_at", F.lit(None).cast("long"))
    head = queue.claim_oldest(held, 10, "w", 5).first()
    assert (head.state, head.lease_holder, head.lease_expires_at) == ("leased", "w", 1010)
    assert queue.claim_oldest(held.withColumns({"state": F.lit("leased"), "lease_expires_at": F.lit(10)}), 10, "w", 5).collect() == []


def test_only_the_holder_renews_a_lease(spark):
    jobs = spark.createDataFrame([("a", "running", "w", 5), ("b", "running", "v", 5), ("c", "queued", None, None)], "id string, state string, lease_holder string, lease_expires_at long")
    beats = spark.createDataFrame([(i, "w") for i in "abcd"], "id string, holder string")
    got = {r.id: (r.applied, r.lease_expires_at) for r in queue.beaten(jobs, beats, 100, 1).collect()}
    assert got == {"a": (True, 1100), "b": (False, 5), "c": (False, None), "d": (False, None)}


FACTS = "id string, status string, unknown_reasons array<string>, frontier int, may_call int, captures int, externals int, receivers int, unknown_call boolean, registers_callback boolean, escaped boolean, reads_global boolean, heap boolean, incomplete_sites boolean, top_level boolean, globals array<string>"


def profile(spark, **facts):
    names = [c.split()[0] for c in FACTS.split(", ")]
    row = dict.fromkeys(names) | {"id": "f", "status": "complete_within_profile"} | facts
    return decisions.execution_profile(spark.createDataFrame([tuple(row[n] for n in names)], FACTS)).first()


def test_profiles_of_facts(spark):
    pure = profile(spark)
    assert (pure["class"], pure.runnable, pure.reasons, pure.grants) == ("pure_callable", True, "", "")
    assert profile(spark, status=None)["class"] == "needs_context"  # an unknown status is no proof
    assert profile(spark, unknown_reasons=["dynamic_code"], unknown_call=True)["class"] == "unsupported"
    assert profile(spark, unknown_call=True, captures=1).reasons == "unknown_call,captured_binding"
    inner, top = profile(spark, captures=1), profile(spark, captures=1, top_level=True)
    assert (inner.runnable, inner.unsatisfiable, inner.grants) == (False, "captures", "")
    assert (top.runnable, top.unsatisfiable, top.grants) == (True, "", "unknown_calls")
    named = profile(spark, reads_global=True, globals=["console"], receivers=1)
    assert (named.context, named.grants) == ("globals,this_arg", "")
    assert profile(spark, reads_global=True).grants == "unknown_calls"


def test_decoded_values_keep_what_json_cannot_say(spark):
    tagged = lambda kind, **more: {"kind": kind, **more}
    cases = [
        (tagged("null"), "null"),
        (tagged("number"), "null"),
        (tagged("string", value="é"), '"é"'),
        (tagged("array"), "[]"),
        (tagged("array", items=[tagged("nan"), tagged("array", items=[tagged("bigint", value="1")])]), '[{"kind":"nan"},["1"]]'),
        (tagged("object", entries={"b": tagged("undefined"), "a": tagged("number", value=1)}), '{"a":1,"b":{"kind":"undefined"}}'),  # keys come in order
        ({"kind": 3}, '{"kind":3}'),
        (tagged("weak_map", value=1), '{"kind":"weak_map"}'),
    ]
    texts = [json.dumps(c) for c, _ in cases] + [None, "{", "[" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, v string")
    assert [r[0] for r in nested.untagged(rows, "v", "got").orderBy("n").select("got").collect()] == [w for _, w in cases] + [None, None, None]


def test_contracts_and_snapshots(spark):
    facts = spark.createDataFrame([("s", "n", "p"), ("t", "n", "p"), ("s", None, "p"), ("s", "n", None)], "schema string, snapshot_id string, producer string")
    got = [r[0] for r in facts.coalesce(1).select(validate.contract("s", "n", "p")).collect()]
    assert got == [None, "language_contract_mismatch", "language_contract_mismatch", "worker_producer_not_supported:got=:expected=p"]
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], "path string, blob string")
    one = lambda f, p="x": catalog.snapshot_id(f, p).first()[0]
    assert one(files) == one(files.orderBy(F.desc("blob")).repartition(3)) != one(files, "y")
    assert one(files) != one(files.where("blob <> '3'"))

"""Dataflow fixpoints, ignore rules, front-end facts, published versions and streams on small inputs."""

import json
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from factloom import session
from factloom.operators import dataflow, ignore
from factloom.sources import language_facts, stores
from factloom.streaming import jobs


def diamond(spark):
    """f: 1 -> 2, 3 -> 4 -> 1; x is set in 1 and 3, y copies x in 4."""
    blocks = spark.createDataFrame([("f", 1, 2), ("f", 1, 3), ("f", 2, 4), ("f", 3, 4), ("f", 4, 1)], "fn string, block long, succ long")
    defs = spark.createDataFrame(
        [("f", 1, 0, "x", "d1", "5", None), ("f", 3, 0, "x", "d3", "6", None), ("f", 4, 1, "y", "d4", None, "u4")], "fn string, block long, idx int, var string, def string, value string, origin string"
    )
    uses = spark.createDataFrame([("f", 4, 0, "x", "u4"), ("f", 4, 2, "y", "u5"), ("f", 2, 0, "z", "u2"), ("f", 1, 1, "x", "u1")], "fn string, block long, idx int, var string, use string")
    return blocks, defs, uses


def test_def_use_and_values(spark):
    blocks, defs, uses = diamond(spark)
    chain = {(r.use, r["def"]) for r in dataflow.def_use(blocks, defs, uses).collect()}
    assert chain == {("u4", "d1"), ("u4", "d3"), ("u5", "d4"), ("u1", "d1")}
    got = {r.use: (r.constants, r.unknown) for r in dataflow.values(blocks, defs, uses).collect()}
    assert got == {"u4": ("5,6", False), "u5": ("5,6", False), "u2": ("", True), "u1": ("5", False)}


def test_names_do_not_matter(spark):
    blocks, defs, uses = diamond(spark)
    renamed = [df.withColumn("var", F.concat(F.lit("v_"), "var")) for df in (defs, uses)]
    plain = sorted(tuple(r) for r in dataflow.values(blocks, defs, uses).collect())
    assert plain == sorted(tuple(r) for r in dataflow.values(blocks, *renamed).collect())


def test_branches_and_loops(spark):
    blocks, _, _ = diamond(spark)
    entry = spark.createDataFrame([("f", 1)], "fn string, block long")
    dead = spark.createDataFrame([("f", 1, 3)], "fn string, block long, succ long")
    assert {r.block for r in dataflow.live_blocks(blocks, entry, dead).collect()} == {1, 2, 4}
    assert {r.block for r in dataflow.loop_blocks(blocks).collect()} == {1, 2, 3, 4}
    assert dataflow.loop_blocks(blocks.where("succ > block")).isEmpty()


def unshuffled(spark, monkeypatch):
    """The plans of tables that are dealt again from dealt ones."""
    plans = []

    def dealt(df, n, *keys):
        with session._met_in_place(spark):
            plans.append(df.repartition(n, *keys)._jdf.queryExecution().executedPlan().toString())
        return session.dealt(df, n, *keys)

    monkeypatch.setattr(dataflow, "dealt", dealt)
    return plans


def lines(spark):
    """Chains of 1 to 9 blocks, each third one a loop; odd blocks define what the next reads."""
    rows = [(f, b, n) for f in range(40) for n in [f % 9 + 1] for b in range(1, n + 1)]
    ln = spark.createDataFrame(rows, "fn long, block long, n long")
    solve = lambda ln: (
        ln.select("fn", "block", F.when(F.col("block") < F.col("n"), F.col("block") + 1).when(F.col("fn") % 3 == 0, 1).cast("long").alias("succ")),
        ln.where("block % 2 = 1").select("fn", "block", F.lit(1).alias("idx"), (F.col("block") % 3).alias("var"), F.col("block").alias("def"), F.when(F.col("block") % 5 > 0, F.col("block").cast("string")).alias("value"), F.when(F.col("block") % 5 == 0, F.col("block")).alias("origin")),
        ln.select("fn", "block", F.lit(0).alias("idx"), (F.col("block") % 3).alias("var"), F.col("block").alias("use")),
    )
    return ln, len(rows), solve


@pytest.mark.parametrize("what", [dataflow.values, lambda b, d, u, *r: dataflow.loop_blocks(b, *r)])
def test_dealt_functions_and_spread_ones_agree(spark, what):
    ln, n, solve = lines(spark)
    want = sorted(tuple(r) for r in what(*solve(ln)).collect())
    got = dataflow.by_function(ln, n, lambda part, rounds: what(*solve(part), rounds), small=5)
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_rounds_of_dealt_functions_shuffle_nothing(spark, monkeypatch):
    ln, n, solve = lines(spark)
    plans = unshuffled(spark, monkeypatch)
    monkeypatch.setattr(dataflow, "buckets", lambda *_: 3)
    dataflow.by_function(ln, n, lambda part, rounds: dataflow.values(*solve(part), rounds))
    shuffles = [p.count("Exchange ") for p in plans]
    # the first deals the rows; copies' readers and uses without a definition come as a union
    assert shuffles[0] == 1 and len(shuffles) > 12 and sum(shuffles[1:]) <= 2


def test_validation_of_dealt_flows_shuffles_nothing(spark):
    ln = session.dealt(lines(spark)[0].select("fn", F.col("block").alias("id")), 3, "fn")
    one = ln.select("fn", "id", F.col("id").alias("scope")), ln.select("fn", "id", (F.col("id") - 1).alias("parent")), ln.select("fn", "id", (F.col("id") + 1).alias("binding"))
    with session._met_in_place(spark):
        bad = dataflow.invalid_flow(*one)
        assert "Exchange" not in bad._jdf.queryExecution().executedPlan().toString()
        assert {(r.fn, r.id) for r in bad.where("problem = 'scope_without_parent'").collect()} == {(f, 1) for f in range(40)}


def test_effects_and_returns(spark):
    own = spark.createDataFrame([("c", "writes")], "fn string, effect string")
    calls = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", None)], "fn string, callee string")
    assert {(r.fn, r.effect) for r in dataflow.effects(own, calls).collect()} == {("a", "writes"), ("b", "writes"), ("c", "writes"), ("d", "unknown_call")}
    fns = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "fn string")
    got = dataflow.never_returns(fns, fns.where("fn <> 'c'"), calls.where("fn = 'b'"))
    assert {r.fn for r in got.collect()} == {"c", "b"}


def test_flow_validation(spark):
    b = spark.createDataFrame([("f", "b1", "s1"), ("f", "b1", "s1"), ("f", "b2", "s9")], "fn string, id string, scope string")
    s = spark.createDataFrame([("f", "s1", None), ("f", "s2", "s8")], "fn string, id string, parent string")
    r = spark.createDataFrame([("f", "r1", "b1"), ("f", "r2", "b7")], "fn string, id string, binding string")
    got = {(x.id, x.problem) for x in dataflow.invalid_flow(b, s, r).collect()}
    assert got == {("b1", "duplicate_binding"), ("b2", "binding_without_scope"), ("s2", "scope_without_parent"), ("r2", "unknown_binding")}


def test_ignore_rules(spark):
    rules = ignore.rules(spark.createDataFrame([(".gitignore", "*.log\n!keep.log\n/build\ndocs/**/x.md\na?c\n# no\n\n"), ("sub/.gitignore", "!*.log\nlocal/")], "path string, text string"))
    paths = ["a.log", "keep.log", "d/keep.log", "build/x", "d/build/x", "docs/x.md", "docs/1/2/x.md", "abc", "a/c", "sub/a.log", "sub/local/f", "local/f", "node_modules/p/i.js", "ok.js"]
    got = {r.path for r in ignore.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).where("ignored").collect()}
    assert got == {"a.log", "build/x", "docs/x.md", "docs/1/2/x.md", "abc", "sub/local/f", "node_modules/p/i.js"}


SCRIPT = "import { b } from './lib/b.js'\nimport type { T } from '../up'\nimport z from 'bare';\nfunction é1() { b(); x.y() }\nfunction two(a) { if (a) two(1); new Q() }\n"


def test_script_facts(spark):
    files = spark.createDataFrame([("src/a.js", SCRIPT), ("src/lib/b.js", "eval('1')"), ("up.ts", "")], "path string, text string")
    heads = {r.name: r for r in language_facts.functions(files).collect()}
    assert set(heads) == {"two"}  # names beyond ASCII are not guessed at
    raw = SCRIPT.encode()
    assert raw[heads["two"].start : heads["two"].end] == b"function two("
    got = {(r.label, r.owner) for r in language_facts.calls(files).where("path = 'src/a.js'").collect()}
    assert got == {("b", None), ("two", heads["two"].id), ("Q", heads["two"].id)}
    imports = {r.specifier: (r.target_path, r.type_only) for r in language_facts.static_imports(files).collect()}
    assert imports == {"./lib/b.js": ("src/lib/b.js", False), "../up": ("up.ts", True), "bare": (None, False)}
    assert [r.path for r in language_facts.dynamic_files(files).collect()] == ["src/lib/b.js"]


def test_language_facts_contract(spark, tmp_path):
    doc = {"schema": language_facts.SCHEMA, "snapshot_id": "s", "producer": "p", "parsed_files": ["a.js"], "symbols": [{"id": "symbol:a.js:0:1", "path": "a.js", "name": "f", "start": 0, "end": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = language_facts.read(spark, str(tmp_path), "s")
    assert got["symbols"].first().name == "f" and got["calls"].isEmpty()
    with pytest.raises(ValueError, match="contract_mismatch"):
        language_facts.read(spark, str(tmp_path), "other")


def test_of_publishers_that_run_together_one_wins(spark, tmp_path):
    base = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        runs = [pool.submit(stores.publish, {"a": spark.range(k + 1), "b": spark.range(10 * (k + 1))}, base, "v") for k in range(4)]
    won = [k for k, r in enumerate(runs) if r.exception() is None]
    assert len(won) == 1 and all("conflict" in str(r.exception()) for k, r in enumerate(runs) if k not in won)
    assert stores.load(spark, base, "v", "a").count() == won[0] + 1 and stores.load(spark, base, "v", "b").count() == 10 * (won[0] + 1)
    assert len(list((tmp_path / "_versions").iterdir())) == 1  # the others' files are gone
    assert {(r.relation, r.n) for r in stores.versions(spark, base).collect()} == {("a", won[0] + 1), ("b", 10 * (won[0] + 1))}


def test_a_publisher_that_fails_leaves_nothing(spark, tmp_path):
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        stores.publish({"a": spark.range(3), "b": bad}, str(tmp_path), "v")
    assert not stores.committed(spark, str(tmp_path), "v") and not list((tmp_path / "_versions").iterdir())
    assert stores.publish({"a": spark.range(3)}, str(tmp_path), "v") == {"a": 3}


def test_publishing_is_atomic_and_once(spark, tmp_path):
    base = str(tmp_path / "store")
    rows = {"nodes": spark.range(3), "edges": spark.range(2)}
    with pytest.raises(ValueError, match="not_found"):
        stores.load(spark, base, "v1", "nodes")
    stores.publish(rows, base, "v1")
    assert stores.load(spark, base, "v1", "nodes").count() == 3
    with pytest.raises(ValueError, match="conflict"):
        stores.publish(rows, base, "v1")


def test_recent_projects(spark):
    p = spark.createDataFrame([(f"r{i % 10}", i) for i in range(20)], "root string, opened_at long")
    assert [r.root for r in stores.recent_projects(p).collect()] == [f"r{i}" for i in range(9, 1, -1)]


def test_lease_stream(spark, tmp_path):
    schema = "id string, kind string, ts timestamp, lease_ms long"
    src = tmp_path / "in"

    def feed(n, rows):
        spark.createDataFrame(rows, "id string, kind string, ts string, lease_ms long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))

    feed(0, [("a", "start", "2024-01-01 00:00:00", 60_000), ("b", "start", "2024-01-01 00:00:00", 60_000), ("b", "finish", "2024-01-01 00:00:30", 0)])
    out = jobs.leases(spark.readStream.schema(schema).parquet(str(src)))
    run = out.writeStream.outputMode("append").format("memory").queryName("lease_stream").start()
    run.processAllAvailable()
    feed(1, [("c", "start", "2024-01-01 01:00:00", 60_000)])
    run.processAllAvailable()
    feed(2, [("d", "start", "2024-01-01 01:00:01", 60_000)])
    run.processAllAvailable()
    run.stop()
    got = {(r.id, r.state) for r in spark.table("lease_stream").collect()}
    assert got == {("a", "expired"), ("b", "finished")}


def test_drained_stream_goes_on_after_a_stop(spark, tmp_path):
    src, folder = tmp_path / "in", str(tmp_path / "kept")

    def feed(keys):
        rows = [(k, f"2024-01-01 00:{k:02}:00", "a" if k % 2 else "b") for k in keys]
        spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))

    def counts(place, files=1):
        rows = spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", files).parquet(str(src))
        return {r.event_type: r.n for r in jobs.drained(jobs.outcome_counts(rows), place).collect()}

    spark.createDataFrame([], "event_id long, ts timestamp, event_type string").write.parquet(str(src))
    feed(range(0, 10))
    feed(range(5, 15))
    assert counts(folder) == {"a": 7, "b": 8}
    assert counts(folder) == {"a": 7, "b": 8}
    feed(range(10, 20))
    # as if the driver had stopped between the batch's rows and its mark: its folder is there, and it is run again
    whole = counts(folder)
    marks = sorted((tmp_path / "kept" / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    marks[-1].unlink()
    (marks[-1].parent / f".{marks[-1].name}.crc").unlink(missing_ok=True)
    assert counts(folder) == whole == counts(str(tmp_path / "anew"), 100) == {"a": 10, "b": 10}


def test_no_local_checkpoint():
    import pathlib

    for p in pathlib.Path(__file__).parent.parent.glob("factloom/**/*.py"):
        assert not re.search(r"localCheckpoint", p.read_text())

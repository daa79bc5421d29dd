"""Operators on hand-made and generated inputs; golden behaviours and laws."""

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import catalog, decisions, documents, folding, patch, queue, rollup, search, traverse, versions


def one(df):
    return df.first()[0]


def graph_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def brute_components(pairs):
    to = defaultdict(set)
    nodes = {x for p in pairs for x in p}
    for a, b in pairs:
        to[a].add(b)

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in to[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    r = {n: reach(n) for n in nodes}
    return {n: min(m for m in r[n] if n in r[m]) for n in nodes}


@pytest.mark.parametrize("rest", [0, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed, rest):
    rng = random.Random(seed)
    pairs = [(rng.randrange(24), rng.randrange(24)) for _ in range(34)]
    got = {r.id: r.comp for r in traverse.strong_components(graph_of(spark, pairs), rest=rest).collect()}
    assert got == brute_components(pairs)


def test_recursive_components_only(spark):
    got = {(r.id, r.comp) for r in traverse.strong_components(graph_of(spark, [(1, 2), (2, 1), (2, 3), (4, 4)]), singletons=False).collect()}
    assert got == {(1, 1), (2, 1), (4, 4)}


def edges(spark, rows):
    return spark.createDataFrame(rows, "id string, source string, target string")


def chain(spark, n):
    return edges(spark, [(f"e{i}", f"n{i}", f"n{i + 1}" if i < n - 1 else None) for i in range(n)])


def test_reach_of_a_chain(spark):
    r = traverse.bounded_reach(chain(spark, 7), "n0", 100, 400)
    assert (len(r.nodes), len(r.edges), len(r.unresolved), r.truncated) == (7, 6, 1, False)
    r = traverse.bounded_reach(chain(spark, 7), "n0", 2, 2)
    assert r.truncated and r.frontier and r.nodes == {"n0", "n1"}
    with pytest.raises(ValueError):
        traverse.bounded_reach(chain(spark, 2), "n0", 501, 1)


def fifo(rows, root, max_nodes, max_edges):
    out = defaultdict(list)
    for e in sorted(rows):
        out[e[1]].append(e)
    nodes, kept, unresolved, frontier, cut, examined = {root}, set(), [], set(), False, 0
    todo = [root]
    while todo:
        n = todo.pop(0)
        for e in out[n]:
            if examined >= max_edges:
                frontier.add(n)
                cut = True
                break
            examined += 1
            if e[2] is None:
                unresolved.append(e[0])
            elif e[2] in nodes:
                kept.add(e[0])
            elif len(nodes) < max_nodes:
                nodes.add(e[2])
                kept.add(e[0])
                todo.append(e[2])
            else:
                frontier.add(e[2])
                cut = True
        if examined >= max_edges:
            frontier.update(todo)
            cut |= bool(todo)
            break
    return nodes, kept, unresolved, frontier, cut


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.integers(1, 8), st.integers(1, 14))
def test_bounded_reach_is_fifo(spark, seed, max_nodes, max_edges):
    rng = random.Random(seed)
    rows = [(f"e{i:02}", f"n{rng.randrange(6)}", rng.choice([None, *[f"n{j}" for j in range(9)]])) for i in range(16)]
    r = traverse.bounded_reach(edges(spark, rows), "n0", max_nodes, max_edges)
    assert (r.nodes, r.edges, r.unresolved, r.frontier, r.truncated) == fifo(rows, "n0", max_nodes, max_edges)


def test_levels_and_closure_digests(spark):
    pairs = [(1, 2), (2, 3), (3, 2), (4, 1)]
    e = graph_of(spark, pairs)
    comps = traverse.strong_components(e)
    levels = traverse.topological_levels(e, comps)
    assert {r.comp: r.level for r in levels.collect()} == {2: 0, 1: 1, 4: 2}

    def digests(changed):
        files = spark.createDataFrame([(i, f"h{i}" + ("x" if i == changed else "")) for i in range(1, 5)], "id long, hash string")
        return {r.comp: r.closure for r in traverse.closure_digests(files, e, comps).collect()}

    base, deep, top = digests(0), digests(3), digests(4)
    assert all(base[c] != deep[c] for c in base)  # a change moves all that depend on it
    assert top[1] == base[1] and top[2] == base[2] and top[4] != base[4]


def levels_by_hand(pairs, n, hashes=()):
    kids = {}
    for a, b in pairs:
        kids.setdefault(a, set()).add(b)
    level, digest = {}, {}
    for a in range(n):  # edges point at smaller numbers
        level[a] = 1 + max((level[b] for b in kids.get(a, ())), default=-1)
        text = f"{a}={dict(hashes).get(a, f'h{a}')}" + ("\0" + "\n".join(sorted(digest[b] for b in kids[a])) if a in kids else "")
        digest[a] = hashlib.sha256(text.encode()).hexdigest()
    return level, digest


def test_levels_and_digests_of_a_random_graph(spark):
    rng = random.Random(1)
    pairs = [(a, rng.randrange(max(0, a - 9), a)) for a in range(1, 40) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
    level, digest = levels_by_hand(pairs, 40)
    comps = spark.range(40).select("id", F.col("id").alias("comp"))
    files = spark.range(40).select("id", F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"))
    e = graph_of(spark, pairs)
    assert {r.comp: r.level for r in traverse.topological_levels(e, comps).collect()} == level
    before = traverse.closure_digests(files, e, comps)
    assert {r.comp: r.closure for r in before.collect()} == digest
    edited = files.withColumn("hash", F.when(F.col("id") == 20, "h99").otherwise(F.col("hash")))
    whole = levels_by_hand(pairs, 40, {20: "h99"})[1]
    rows = traverse.changed_closures(before, files, edited, e, comps).collect()
    assert {r.comp: r.closure for r in rows} == whole and len(rows) == 40
    assert {r.comp for r in rows if r.fresh} == {c for c in whole if whole[c] != digest[c]}  # no component is digested for nothing


def test_long_chains_take_few_jobs(spark):
    """A chain of 100,000, each link pointing at the chain's end too: rounds grow with the logarithm of its length."""
    n = 100_000
    ids = spark.range(n)
    e = ids.where("id > 0").select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    comps = ids.select("id", F.col("id").alias("comp"))
    e = e.unionByName(ids.where("id > 1").select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")))
    spark.sparkContext.setJobGroup("chain", "levels of a chain")
    levels = traverse.topological_levels(e, comps)
    assert levels.where("comp <> level").count() == 0 and levels.count() == n
    made = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert made < 150  # a job is a stage where plans are adaptive


def test_byte_functions(spark):
    df = spark.createDataFrame([("水🫧abc\nd",)], "t string")
    t = F.col("t")
    got = df.select(
        *[text.on_boundary(t, F.lit(i)) for i in (0, 1, 3, 5, 7, 12, 13)], text.boundary_before(t, F.lit(6)), text.line_of(t, F.lit(11)), F.decode(text.bytes_at(t, F.lit(3), F.lit(4)), "UTF-8")
    ).first()
    assert tuple(got) == (True, False, True, False, True, True, False, 3, 2, "🫧")


def test_paths_and_kinds(spark):
    df = spark.createDataFrame([("a/b.js",), ("/a",), ("a//b",), ("../a",), ("a\\b",), ("a/b.mts",)], "p string")
    assert [r[0] for r in df.select(text.safe_path(F.col("p"))).collect()] == [True, False, False, False, False, True]
    assert [r[0] for r in df.select(text.is_source(F.col("p"))).collect()] == [True, False, False, False, False, True]


def test_budget_is_refused_with_figures(spark):
    files = spark.createDataFrame([("a", 5), ("b", 6)], "path string, bytes long")
    catalog.check_budget(files, 2, 11)
    with pytest.raises(ValueError, match="2 entries, limit 1"):
        catalog.check_budget(files, 1, 99)
    with pytest.raises(ValueError, match="11 bytes, limit 10"):
        catalog.check_budget(files, 2, 10)


def test_pages_join_up(spark):
    rows = spark.range(25).select(F.col("id"))
    key, got, at = ("q",), [], None
    while True:
        part, total, at = search.page(rows, key, ["id"], 10, at)
        got += [r.id for r in part.collect()]
        if at is None:
            break
    assert got == list(range(25)) and total == 25
    with pytest.raises(ValueError, match="cursor_query_mismatch"):
        search.page(rows, ("other",), ["id"], 10, search.cursor(key, 10))
    with pytest.raises(ValueError, match="cursor_outside_result"):
        search.page(rows, key, ["id"], 10, search.cursor(key, 26))
    with pytest.raises(ValueError, match="limit"):
        search.page(rows, key, ["id"], 501)


def test_search_folds_ascii_alone(spark):
    n = spark.createDataFrame([("1", "p", "ÀB_100%"), ("2", "p", "àb"), ("3", "p/AB", "x")], "id string, path string, name string")
    ids = lambda q: {r.id for r in search.matching(n, q).collect()}
    assert ids("àB") == {"2"} and ids("ab") == {"3"} and ids("0%") == {"1"} and ids(" _1 ") == {"1"}


def test_gather_is_greedy(spark):
    p = spark.createDataFrame([(1, 0, 6), (1, 1, 9), (1, 2, 4), (2, 0, 20)], "owner long, seq long, size long")
    got = {r.owner: (r.used, r.admitted, r.truncated, r.seqs) for r in documents.gather(p, 10).collect()}
    assert got == {1: (10, 2, True, "0,2"), 2: (0, 0, True, "")}


def test_sections_skip_fences(spark):
    md = spark.createDataFrame([("a.md", "# Ä\ntext\n```\n# no\n```\n## Two\n#no")], "path string, text string")
    assert [tuple(r)[1:] for r in documents.sections(md).orderBy("start").collect()] == [("Ä", 1, 0, 23), ("Two", 2, 23, 33)]


def test_leading_comments(spark):
    df = spark.createDataFrame([("x;\n/* a\n b */\n",), ("// one\n// two\n",), ("x = 1;\n",), ("/* far */ y;\n",)], "t string")
    assert [r[0] for r in df.select(documents.leading_comment(F.col("t"))).collect()] == ["a\n b", "one\ntwo", None, None]


def test_diff_of_a_version_with_itself_is_empty(spark):
    v = spark.createDataFrame([("file", "p", "n", 0, 1, "b"), ("file", "p", "n", 2, 3, "c")], "kind string, path string, name string, start long, end long, blob string")
    assert versions.node_diff(v, v).isEmpty() and versions.edge_diff(v, v, ["kind", "path"]).isEmpty()


def test_relocation_rules(spark):
    s = "id string, path string, name string, blob string"
    old = spark.createDataFrame([("1", "p", "f", "x"), ("2", "p", "g", "y"), ("3", "p", "h", "z"), ("4", "p", "i", "w"), ("5", "q", "none", "v"), ("6", "r", "k", "u")], s)
    new = spark.createDataFrame([("a", "p", "f", "x2"), ("b", "m", "g", "y"), ("c", "m", "g", "other"), ("d", "m", "h", "z2"), ("e", "m", "i", "1"), ("f", "n", "i", "2")], s)
    got = {r.id: (r.rule, r.to_id, r.bytes_changed) for r in versions.relocate(old, new).collect()}
    assert got == {
        "1": ("path_and_name", "a", True),
        "2": ("same_bytes", "b", False),
        "3": ("name", "d", True),
        "4": ("ambiguous", None, None),
        "5": ("no_counterpart", None, None),
        "6": ("no_counterpart", None, None),
    }


def test_patched_refuses_a_path_twice(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    with pytest.raises(ValueError):
        versions.patched(base, base, base.select("path"))


def test_lifecycle(spark):
    e = spark.createDataFrame([(1, 1, "apply"), (1, 2, "verify"), (1, 3, "apply"), (1, 4, "revert"), (1, 5, "reject"), (2, 1, "reject"), (2, 2, "verify")], "id long, at long, action string")
    assert {r.id: (r.state, r.refused) for r in queue.lifecycle(e).collect()} == {1: ("reverted", 2), 2: ("rejected", 1)}


def test_reaping_differs_by_kind(spark):
    j = spark.createDataFrame([("a", "running", 5), ("b", "running", 50), ("c", "queued", None)], "id string, state string, lease_expires_at long")
    assert [tuple(r) for r in queue.reaped(j, 10, "failed").collect()] == [("a", "failed", "lease_expired")]
    assert [tuple(r) for r in queue.reaped(j, 10, "queued").collect()] == [("a", "queued", None)]


def values():
    return {
        "undefined": folding.value("undefined"),
        "null": folding.value("null"),
        "nan": folding.value("num", num=F.lit(float("nan"))),
        "inf": folding.value("num", num=F.lit(float("inf"))),
        "0": folding.value("num", num=F.lit(0.0)),
        "1.5": folding.value("num", num=F.lit(1.5)),
        "7": folding.value("num", num=F.lit(7.0)),
        "''": folding.value("str", text=F.lit("")),
        "'7'": folding.value("str", text=F.lit(" 7 ")),
        "'x'": folding.value("str", text=F.lit("x")),
        "true": folding.value("bool", flag=F.lit(True)),
    }


@pytest.mark.parametrize(
    "op,a,b,want",
    [
        ("+", "7", "'x'", "str:7x"),
        ("+", "null", "true", "num:1"),
        ("+", "undefined", "7", "num:NaN"),
        ("+", "inf", "'x'", "str:Infinityx"),
        ("-", "'7'", "7", "num:0"),
        ("/", "7", "0", "num:Infinity"),
        ("/", "0", "0", "num:NaN"),
        ("===", "nan", "nan", "bool:false"),
        ("===", "null", "undefined", "bool:false"),
        ("!==", "7", "7", "bool:false"),
        ("<", "1.5", "7", "bool:true"),
        ("<", "nan", "7", "bool:false"),
        ("<", "'x'", "7", None),
        ("&&", "''", "7", "str:"),
        ("||", "0", "'x'", "str:x"),
        ("??", "null", "7", "num:7"),
        (",", "7", "true", "bool:true"),
        ("%", "7", "7", None),
    ],
)
def test_folding(spark, op, a, b, want):
    v = values()
    assert one(spark.range(1).select(folding.shown(folding.binary(F.lit(op), v[a], v[b])))) == want


def test_truth(spark):
    got = spark.range(1).select(*[folding.truthy(v) for v in values().values()]).first()
    assert tuple(got) == (False, False, False, True, False, True, True, False, True, True, True)


def test_lattice(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c")], "k long, v string")
    u, over = rollup.capped_union(F.col("v"), 2)
    got = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(u, over, rollup.initialised(F.col("v"))).collect()}
    assert got == {1: ("a", False, "a"), 2: ("a,b", False, "maybe"), 3: ("", True, "maybe")}


def test_capped_unions_of_large_groups(spark):
    rows = [(1, f"v{i % 500}") for i in range(2000)] + [(2, "b"), (2, None), (2, "a"), (3, None), (4, None), *((4, c) for c in "abc"), *((5, c) for c in "ab")]
    got = {r.k: tuple(r)[1:] for r in rollup.capped_unions(spark.createDataFrame(rows, "k long, v string"), ["k"], F.col("v"), 2).collect()}
    assert got == {1: ("", True), 2: ("a,b", False), 3: ("", False), 4: ("", True), 5: ("a,b", False)}


def test_decision_names_all_that_is_missing(spark):
    f = spark.createDataFrame([(1, False, False, True, True, True)], "id long, unknown boolean, is_nested boolean, network boolean, files boolean, mutates boolean")
    got = decisions.decide(decisions.profile(f), F.array(F.lit("context"))).first()
    assert (got.decision, got.missing) == ("needs_grants", "files,network")


DIFF = """--- a/x.js
+++ b/x.js
@@ -1,3 +1,3 @@
 one
--- two
+2
 three
@@ -5 +5,2 @@
 five
+six
--- /dev/null
+++ b/new.js
@@ -0,0 +1,2 @@
+n1
+n2
--- a/old.js
+++ /dev/null
@@ -1 +0,0 @@
-gone
"""


def test_patch(spark):
    lines = patch.parse(spark.createDataFrame([("p", DIFF)], "patch string, text string"))
    rep = {r.path: (r.op, r.hunks, r.added, r.removed, r.problem) for r in patch.report(lines).collect()}
    assert rep == {"x.js": ("modify", 2, 2, 1, None), "new.js": ("create", 1, 2, 0, None), "old.js": ("delete", 1, 0, 1, None)}
    files = spark.createDataFrame([("x.js", "one\n-- two\nthree\nfour\nfive\n"), ("old.js", "gone")], "path string, text string")
    got = {r.path: (r.problem, r.text) for r in patch.apply(lines, files).collect()}
    assert got == {"x.js": (None, "one\n2\nthree\nfour\nfive\nsix\n"), "new.js": (None, "n1\nn2\n"), "old.js": (None, None)}
    other = spark.createDataFrame([("x.js", "uno\n-- two\nthree\nfour\nfive\n"), ("new.js", "")], "path string, text string")
    assert {r.path: r.problem for r in patch.apply(lines, other).collect()} == {"x.js": "context_mismatch", "new.js": "already_exists", "old.js": "no_such_file"}


@pytest.mark.parametrize(
    "diff,problem",
    [
        ("rename from a\nrename to b\n", "rename_refused"),
        ("--- a/x\n+++ b/y\n@@ -1 +1 @@\n-a\n+b\n", "headers_disagree"),
        ("--- a/x\n+++ b/x\n@@ -1,2 +1 @@\n-a\n+b\n", "hunk_too_short"),
        ("--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n+c\n", "hunk_too_long"),
        ("--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n", "path_twice"),
    ],
)
def test_malformed_diffs(diff, problem):
    assert [x[-1] for x in patch.hunk_lines(diff)][-1] == problem

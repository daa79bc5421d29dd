"""Searches from many roots against a queue, root by root; ids of contexts."""

import random
import re

import pytest
from test_operators import edges, fifo

from factloom.operators import contexts
from factloom.sources import projections


@pytest.mark.parametrize("seed,max_nodes,max_edges", [(1, 4, 5), (2, 8, 14), (3, 1, 1), (4, 5, 9), (5, 40, 120), (6, 3, 7)])
def test_all_roots_are_fifo(spark, seed, max_nodes, max_edges):
    rng = random.Random(seed)
    rows = [(f"e{i:02}", f"n{rng.randrange(8)}", rng.choice([None, *[f"n{j}" for j in range(11)]])) for i in range(24)]
    roots = [f"n{j}" for j in range(11)] + ["alone", "n0", None]
    got = contexts.reach_of_all(edges(spark, rows), spark.createDataFrame([(r,) for r in roots], "root string"), max_nodes, max_edges).collect()
    assert sorted(r.root for r in got) == sorted({r for r in roots if r})
    for r in got:
        assert (set(r.nodes), set(r.edges), r.unresolved, set(r.frontier), r.truncated) == fifo(rows, r.root, max_nodes, max_edges)
        assert r.nodes[0] == r.root and len(set(r.frontier)) == len(r.frontier)


def test_no_edges_and_no_roots(spark):
    none = edges(spark, [])
    roots = spark.createDataFrame([("a",)], "root string")
    assert [(r.nodes, r.edges, r.truncated) for r in contexts.reach_of_all(none, roots, 2, 2).collect()] == [(["a"], [], False)]
    assert contexts.reach_of_all(none, roots.where("false"), 2, 2).collect() == []
    with pytest.raises(ValueError):
        contexts.reach_of_all(none, roots, 501, 2)


def test_a_node_of_many_edges_is_cut(spark):
    rows = [(f"e{i:04}", "hub", f"n{i}") for i in range(3000)] + [("z", "r", "hub")]
    (r,) = contexts.reach_of_all(edges(spark, rows), spark.createDataFrame([("r",)], "root string"), 40, 120).collect()
    assert (set(r.nodes), set(r.edges), r.unresolved, set(r.frontier), r.truncated) == fifo(rows, "r", 40, 120)


def test_frequent_and_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(contexts, "FREQUENT", 3)
    monkeypatch.setattr(contexts, "LARGE", 4)
    rows = [(f"e{i:02}", f"n{i % 9}", "hub" if i % 3 else None) for i in range(27)] + [(f"h{i:02}", "hub", f"n{i}") for i in range(11)]
    roots = [f"n{j}" for j in range(11)] + ["hub"]
    for max_nodes, max_edges in ((5, 9), (40, 120)):
        got = contexts.reach_of_all(edges(spark, rows), spark.createDataFrame([(r,) for r in roots], "root string"), max_nodes, max_edges).collect()
        assert sorted(r.root for r in got) == sorted(roots)
        for r in got:
            assert (set(r.nodes), set(r.edges), r.unresolved, set(r.frontier), r.truncated) == fifo(rows, r.root, max_nodes, max_edges)


def test_a_round_moves_what_it_looks_up_alone(spark, monkeypatch):
    rounds, dealt = [], contexts.dealt

    def seen(df, n, *keys, there=False):
        if there and keys == ("root",):
            rounds.append(df._jdf.queryExecution().executedPlan().toString())
        return dealt(df, n, *keys, there=there)

    monkeypatch.setattr(contexts, "dealt", seen)
    monkeypatch.setattr(contexts, "buckets", lambda *_: 3)
    rows = [(f"e{i}", f"n{i}", f"n{i + 1}") for i in range(3)]
    contexts.reach_of_all(edges(spark, rows), spark.createDataFrame([("n0",)], "root string"), 40, 120)
    # the nodes go to their edges and these back to the searches, which stay
    assert len(rounds) == 4 and all(p.count("Exchange hashpartitioning") == 2 for p in rounds)


def test_lines_are_dealt_without_their_text(spark):
    files = spark.createDataFrame([(1, "a/b/doc_1.txt", "alpha x\n\nbeta")], "doc_id long, path string, text string")
    rows = projections.symbols(files)
    assert [(r.i, r.start, r.end, r.name, r.line) for r in rows.orderBy("i").collect()] == [(0, 0, 7, "alpha_7", "alpha x"), (2, 9, 13, "beta_4", "beta")]
    plan = rows.select("id", "path", "start", "end", "name")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [") :].split("\n")[1]
    assert "name#" in below and not re.search(r"[\[ ]line#\d+[,\]]", below)


def test_context_ids(spark):
    files = spark.createDataFrame([("f", "alpha\nbeta")], "path string, text string")
    spans = spark.createDataFrame([("a", "f", 0, 5), ("b", "f", 6, 10)], "id string, path string, lo long, hi long")

    def ids(rows, limits="l"):
        return {r.id: r.selection for r in contexts.frozen("v", spans, files, edges(spark, rows), limits).collect()}

    one = ids([("e1", "a", "b"), ("e2", "a", None)])
    assert one == ids([("e2", "a", None), ("e1", "a", "b")]) and len(set(one.values())) == 2
    other = ids([("e1", "a", "b")])
    assert other["a"] != one["a"] and other["b"] == one["b"]
    assert ids([("e1", "a", "b"), ("e2", "a", None)], "m")["b"] != one["b"]

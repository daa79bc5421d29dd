"""Scans of folder trees against os.walk, their dispositions, and the data source's pruning."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from factloom.sources import trees


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for i in range(120):
        place = root / f"a{i % 7}" / f"b{i % 13}" / f"c{i % 3}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"f{i}").write_text("x" * i)
    (root / "node_modules" / "x").mkdir(parents=True)
    os.symlink("/nowhere", root / "a1" / "l")
    os.mkfifo(root / "a1" / "p")
    return root


def walked(root):
    out = set()
    for directory, _, files in os.walk(root):
        at = os.path.relpath(directory, root)
        at = "" if at == "." else at
        if not at.startswith("node_modules/"):
            out.add(at)
            out.update(f"{at}/{f}" if at else f for f in files)
    return out


@pytest.mark.parametrize("room", [1, 3, trees.ROOM])
def test_tree_is_the_walk(spark, root, room):
    got = [r.path for r in trees.tree(spark, str(root), room=room).collect()]
    assert sorted(got) == sorted(walked(root))


def test_source_prunes_by_the_begin_of_a_path(spark, root):
    trees.register(spark)
    df = spark.read.format("tree").option("path", str(root)).option("partitions", 5).load()
    assert sorted(r.path for r in df.collect()) == sorted(walked(root))
    for begin in ("a1", "a1/b", "a1/b3/c0", "zzz"):
        assert sorted(r.path for r in df.where(F.col("path").startswith(begin)).collect()) == sorted(p for p in walked(root) if p.startswith(begin))
    assert [r.kind for r in df.where("path = 'a1/l'").collect()] == ["symlink"]


def test_scan(spark, tmp_path):
    for path, text in {
        "keep.js": "1", "big": "x" * 50, "skip.log": "l", "sub/.gitignore": "!skip.log\nlocal\n", "sub/skip.log": "k", "sub/local/deep/f": "f", "sub/deep/f": "f", ".git/config": "c", ".gitignore": "*.log\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    os.symlink("keep.js", tmp_path / "link.log")
    entries, contents = trees.scan(spark, str(tmp_path), 40)
    rows = entries.collect()
    got = {r.path: (r.kind, r.disposition, r.bytes, r.detail) for r in rows}
    assert [r.path for r in rows] == sorted(got)
    assert got["keep.js"] == ("file", "captured", 1, None) and got["big"] == ("file", "oversize", 50, "file_byte_limit")
    assert got["skip.log"] == ("file", "ignored", 1, "gitignore_boundary") and got["sub/skip.log"][1] == "captured"
    assert got["sub/local"] == ("directory", "ignored", 0, "gitignore_boundary") and "sub/local/deep" not in got
    assert got[".git"] == ("directory", "ignored", 0, "builtin_or_store_boundary") and ".git/config" not in got
    assert got["link.log"] == ("symlink", "symlink", 0, "link_not_followed;target_hash:" + hashlib.sha256(b"keep.js").hexdigest())
    assert {r.path: bytes(r.content) for r in contents.collect()}["sub/deep/f"] == b"f"
    with pytest.raises(ValueError, match="entry_budget"):
        trees.scan(spark, str(tmp_path), 40, max_entries=3)
    with pytest.raises(ValueError, match="byte_budget"):
        trees.scan(spark, str(tmp_path), 40, max_total_bytes=3)


def test_names_that_are_refused(spark, tmp_path):
    (tmp_path / "a\\b").write_text("x")
    with pytest.raises(Exception, match="backslash_filename_not_supported"):
        trees.tree(spark, str(tmp_path)).collect()


def test_a_file_that_is_gone_or_too_large_is_not_captured(spark, tmp_path):
    (tmp_path / "f").write_text("12345")
    files = spark.createDataFrame([("f",), ("gone",)], "path string")
    assert {r.path: r.content for r in trees.capture(files, str(tmp_path), 4).collect()} == {"f": None, "gone": None}
    assert {r.path: r.content and bytes(r.content) for r in trees.capture(files, str(tmp_path), 5).collect()} == {"f": b"12345", "gone": None}


def test_rounds_broadcast_no_table(spark):
    """A stored table of long alike ids is small on disk and large on the driver."""
    from factloom.operators import traverse
    from factloom.session import stored

    edges = stored(spark.range(3000).selectExpr("concat(repeat('x', 200), id) AS a", "concat(repeat('x', 200), id + 1) AS b"))
    comps = traverse.strong_components(edges)
    for df in (comps, traverse.condensed(edges, comps)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_rounds_of_colours_keep_no_growing_estimate(spark):
    """The driver holds the estimated size of each round's rows as a whole number; were it that of the round's plan, its digits would double every round."""
    from factloom.operators import traverse

    ring = spark.range(24).selectExpr("id AS a", "(id + 1) % 24 AS b")
    comps = traverse.strong_components(ring, rest=0)
    assert comps._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
    assert [tuple(r) for r in comps.sort("id").collect()] == [(i, 0) for i in range(24)]


def test_colours_spread_in_lots(spark):
    """Two long rings with a one-way bridge, in lots of some 100 ends of edges: as many rounds as lots are passed, not as there are nodes."""
    from factloom.operators import traverse

    pairs = [(i, (i + 1) % 300) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 150) for i in range(150)] + [(5, 1000)]
    edges = spark.createDataFrame(pairs, "a long, b long").selectExpr("CAST(a AS string) AS a", "CAST(b AS string) AS b")
    of = traverse.lots(edges, len(pairs), 100)
    assert of.select("id").distinct().count() == of.count() == 450 and of.select("lot").distinct().count() > 3
    got = {(int(r.id), int(r.comp)) for r in traverse.strong_components(edges, rest=0, lot=100).collect()}
    assert got == {(i, 0) for i in range(300)} | {(1000 + i, 1000) for i in range(150)}

"""Comparing versions: diff, relocation, keys, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes paired by (kind, path, name): added, removed or changed (span or bytes). Repeated keys are paired by count."""
    side = lambda df, s: df.groupBy("kind", "path", "name").agg(
        F.count("*").alias(f"n_{s}"), F.min(F.struct("start", "end")).alias(f"span_{s}"), F.min("blob").alias(f"blob_{s}")
    )
    rows = side(a, "a").join(side(b, "b"), ["kind", "path", "name"], "full")
    change = (
        F.when(F.col("n_a").isNull(), "added")
        .when(F.col("n_b").isNull(), "removed")
        .when((F.col("span_a") != F.col("span_b")) | (F.col("n_a") != F.col("n_b")), "changed")
    )
    return rows.select("kind", "path", "name", change.alias("change"), (~F.col("blob_a").eqNullSafe(F.col("blob_b"))).alias("bytes_changed")).where("change IS NOT NULL")


def edge_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Edges by value: how many more of each there are on either side."""
    n = lambda df, s: df.groupBy(*keys).agg(F.count("*").alias(s))
    left, right = n(a, "n_a").alias("l"), n(b, "n_b").alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    rows = left.join(right, cond, "full").select(
        *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], (F.coalesce("n_b", F.lit(0)) - F.coalesce("n_a", F.lit(0))).alias("delta")
    )
    return rows.where("delta <> 0").withColumn("change", F.when(F.col("delta") > 0, "added").otherwise("removed"))


def relocate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Where each entity of ``old`` (id, path, name, blob) is in ``new``: the same path and name if unique, else the same bytes, else the same
    name; otherwise it is ambiguous or has no counterpart. Candidates share the path or the name."""
    n = new.select(F.col("id").alias("to_id"), F.col("path").alias("to_path"), F.col("name").alias("to_name"), F.col("blob").alias("to_blob"))
    # counts and least ids of ``new`` by key meet each entity once: no pairs. A candidate shares the name or the path, so both less what shares both
    got = old.select("id", "path", "name", "blob")
    for keys, tag in ((["path", "name"], "pn"), (["name"], "n"), (["path"], "p"), (["path", "blob"], "pb"), (["name", "blob"], "nb"), (["path", "name", "blob"], "pnb")):
        per = new.groupBy(*keys).agg(F.count("*").alias(f"c_{tag}"), F.min("id").alias(f"m_{tag}"))
        got = got.join(per, keys, "left").fillna(0, [f"c_{tag}"])
    got = got.select(
        "id",
        F.col("c_pn").alias("n_exact"),
        F.col("m_pn").alias("exact"),
        (F.col("c_pb") + F.col("c_nb") - F.col("c_pnb")).alias("n_bytes"),
        F.least("m_pb", "m_nb").alias("bytes"),
        F.col("c_n").alias("n_name"),
        F.col("m_n").alias("named"),
        (F.col("c_n") + F.col("c_p") - F.col("c_pn")).alias("candidates"),
    )
    rows = old.select("id", "blob").join(got, "id", "left")
    rule = (
        F.when(F.col("n_exact") == 1, "path_and_name").when(F.col("n_bytes") == 1, "same_bytes").when(F.col("n_name") == 1, "name").when(F.col("candidates") > 0, "ambiguous").otherwise("no_counterpart")
    )
    to = F.when(F.col("n_exact") == 1, F.col("exact")).when(F.col("n_bytes") == 1, F.col("bytes")).when(F.col("n_name") == 1, F.col("named"))
    rows = rows.select("id", "blob", rule.alias("rule"), to.alias("to_id"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    rows = rows.join(n.select("to_id", "to_blob"), "to_id", "left")
    return rows.select("id", "rule", "to_id", "candidates", (F.col("blob") != F.col("to_blob")).alias("bytes_changed"))


def verdicts(before: DataFrame, now: DataFrame, deps: DataFrame) -> DataFrame:
    """(path, verdict, via) of files whose key moved: new, own_content, or dependency by way of direct ones that moved.
    ``before``, ``now``: path, key, hash; ``deps``: path, dep."""
    b = before.select("path", F.col("key").alias("old_key"), F.col("hash").alias("old_hash"))
    rows = now.join(b, "path", "left")
    moved = rows.where("old_key IS NULL OR old_key <> key").select(F.col("path").alias("dep"))
    via = deps.join(moved, "dep").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("dep")), ",").alias("via"))
    verdict = F.when(F.col("old_key").isNull(), "new").when(F.col("old_hash") != F.col("hash"), "own_content").when(F.col("old_key") != F.col("key"), "dependency").otherwise("reusable")
    rows = rows.withColumn("verdict", verdict).join(via, "path", "left")
    return rows.select("path", "verdict", F.when(F.col("verdict") == "dependency", F.coalesce("via", F.lit(""))).alias("via"))


def withdrawn(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.select("path").join(now.select("path"), "path", "left_anti")


def patched(base: DataFrame, overrides: DataFrame, deletions: DataFrame) -> DataFrame:
    """``base`` (path, text) with overrides put in and deletions taken out; a path that is both is refused."""
    if not overrides.join(deletions, "path", "left_semi").isEmpty():
        raise ValueError("path_both_changed_and_deleted")
    o = overrides.select("path", F.col("text").alias("new_text"))
    rows = base.join(deletions.select("path"), "path", "left_anti").join(o, "path", "full")
    return rows.select("path", F.coalesce("new_text", "text").alias("text"), F.col("new_text").isNotNull().alias("overridden"))

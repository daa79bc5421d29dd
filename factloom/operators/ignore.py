"""Ignore rules as a join: every rule is a row, the last one that matches a path wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUILTIN = r"(^|/)(\.git|node_modules|target)(/|$)"


def rule_pattern(line: Column) -> Column:
    """The regular expression of one rule line, relative to its file's directory. A rule with an inner slash is anchored; a trailing slash and
    plain names also take what lies below."""
    body = F.regexp_replace(F.regexp_replace(line, "^!", ""), "/$", "")
    anchored = F.regexp_replace(body, "^/", "").contains("/") | body.startswith("/")
    escaped = F.regexp_replace(F.regexp_replace(body, "^/", ""), r"([.+^$(){}|\[\]\\])", r"\\$1")
    for a, b in (("**/", "\u0001"), ("**", "\u0002"), ("*", "[^/]*"), ("?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".*")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.concat(F.when(anchored, "^").otherwise("(^|.*/)"), escaped, F.lit("(/.*)?$"))


def rules(policies: DataFrame) -> DataFrame:
    """(dir, seq, pattern, keep) of policy files (path, text): comments and blanks are no rules, ! takes back."""
    lines = policies.select(F.regexp_replace("path", "[^/]*$", "").alias("dir"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> '' AND line NOT LIKE '#%'")
    return lines.select("dir", "seq", rule_pattern(F.col("line")).alias("pattern"), F.col("line").startswith("!").alias("keep"))


def ignored(paths: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """(path, ignored): deeper policies and later rules win; built-in boundaries always hold. Paths meet only the rules of directories
    above them."""
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n > 0, "/").otherwise("")))
    hits = paths.select("path", F.explode(above).alias("dir")).join(rule_rows, "dir")
    hits = hits.where(F.expr("rlike(substring(path, length(dir) + 1), pattern)"))
    last = hits.groupBy("path").agg(F.max_by("keep", F.struct(F.length("dir"), "seq")).alias("keep"))
    return paths.select("path").join(last, "path", "left").select("path", (F.col("path").rlike(BUILTIN) | ~F.coalesce("keep", F.lit(True))).alias("ignored"))

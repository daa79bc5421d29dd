"""Unified diffs as data: hunks are rows, application is a join of lines.

Parsing is led by the lengths in hunk headers, so that a removed line that looks like a header is a line. Applying is strict: context and
removed lines must stand where the hunk says, shifted by what earlier hunks of the file added and removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.versions import node_diff

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
LINES = "patch string, path string, op string, hunk int, seq int, old_start int, kind string, line string, problem string"
#: Lines, and characters of them, that are handed on together.
AT_ONCE, CHARS = 8192, 1 << 20


def hunk_lines(text: str) -> Iterator[tuple]:
    """(path, op, hunk, seq, old_start, kind, line, problem) of a diff's lines; one row with a problem ends a diff that is malformed."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    i, path, op, hunk = 0, None, None, 0
    seen: set[str] = set()
    bad = lambda why: (path, op, hunk, 0, 0, "", "", why)
    while i < len(lines):
        line = lines[i]
        if line.startswith(("rename ", "copy ", "similarity ")):
            yield bad("rename_refused")
            return
        if line.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            old, new = line[4:].split("\t")[0], lines[i + 1][4:].split("\t")[0]
            op = "create" if old == "/dev/null" else "delete" if new == "/dev/null" else "modify"
            a, b = (x[2:] if x[:2] in ("a/", "b/") else x for x in (old, new))
            path = b if op == "create" else a
            if op == "modify" and a != b:
                yield bad("headers_disagree")
                return
            if path in seen:
                yield bad("path_twice")
                return
            seen.add(path)
            i, hunk = i + 2, 0
            continue
        m = HUNK.match(line)
        if m:
            if path is None:
                yield bad("hunk_without_file")
                return
            hunk += 1
            start, left, right = int(m[1]), int(m[2] or 1), int(m[4] or 1)
            start += left == 0  # an insertion stands after its line
            i, seq = i + 1, 0
            while left > 0 or right > 0:
                got = lines[i] if i < len(lines) else None
                if got is not None and seq and got.startswith("\\ "):  # says that the line before has no newline
                    i += 1
                    continue
                if got is None or (got[:1] not in " +-" and got != ""):
                    yield bad("hunk_too_short")
                    return
                kind = got[:1] or " "
                left -= kind in " -"
                right -= kind in " +"
                if left < 0 or right < 0:
                    yield bad("hunk_too_long")
                    return
                yield (path, op, hunk, seq, start, kind, got[1:], None)
                i, seq = i + 1, seq + 1
            continue
        if line[:1] in ("+", "-", " ") and path is not None and hunk:
            yield bad("hunk_too_long")
            return
        i += 1


def parse(diffs: DataFrame) -> DataFrame:
    """Lines of every diff (patch, text). A task holds the lines of one diff, and at most ``AT_ONCE`` lines or ``CHARS`` characters that are not handed on."""
    return diffs.select("patch", "text").mapInArrow(_parsed, LINES)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(c.split() for c in LINES.split(", ")), strict=True)
    schema = pa.schema([(n, pa.int32() if k == "int" else pa.string()) for n, k in zip(names, kinds, strict=True)])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    rows, held = [], 0
    for batch in batches:
        for patch, text in zip(batch.column(0), batch.column(1), strict=True):
            name = patch.as_py()
            for row in hunk_lines(text.as_py() or ""):
                rows.append((name, *row))
                held += len(row[6])
                if len(rows) == AT_ONCE or held >= CHARS:
                    yield made(rows)
                    rows, held = [], 0
    if rows:
        yield made(rows)


def report(lines: DataFrame) -> DataFrame:
    """Per patch and path: operation, hunks, added and removed lines, and what is wrong."""
    return lines.groupBy("patch", "path").agg(
        F.first("op").alias("op"),
        F.max("hunk").alias("hunks"),
        F.count_if(F.col("kind") == "+").alias("added"),
        F.count_if(F.col("kind") == "-").alias("removed"),
        F.max("problem").alias("problem"),
    )


def apply(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(patch, path, text, problem): ``files`` (path, text) with the hunks applied; a mismatch anywhere refuses the file."""
    in_hunk = Window.partitionBy("patch", "path", "hunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.count_if(F.col("kind") != "+").over(in_hunk), F.lit(0))
    at = lines.where("problem IS NULL").withColumn("line_no", F.col("old_start") - 1 + used)
    base = files.select("path", F.split("text", "\n", -1).alias("l")).select("path", F.posexplode("l").alias("line_no", "have"))
    touched = at.select("patch", "path", "op").distinct()
    have = touched.join(base, "path")
    old = at.where("kind <> '+'").select("patch", "path", "line_no", "kind", "line")
    both = have.join(old, ["patch", "path", "line_no"], "full")
    wrong = both.groupBy("patch", "path").agg(F.bool_or(F.col("kind").isNotNull() & ~F.col("have").eqNullSafe(F.col("line"))).alias("wrong"))
    kept = both.where("kind IS NULL OR kind = ' '").select("patch", "path", F.col("line_no").cast("int").alias("line_no"), F.lit(1).alias("side"), F.lit(0).alias("seq"), F.col("have").alias("out"))
    new = at.where("kind = '+'").select("patch", "path", F.col("line_no").cast("int").alias("line_no"), F.lit(0).alias("side"), "seq", F.col("line").alias("out"))
    rows = kept.unionByName(new).groupBy("patch", "path").agg(F.array_sort(F.collect_list(F.struct("line_no", "side", "seq", "out"))).alias("o"))
    text = F.array_join(F.transform("o", lambda x: x.out), "\n")
    exists = files.select("path").distinct().withColumn("there", F.lit(True))
    out = touched.join(rows, ["patch", "path"], "left").join(wrong, ["patch", "path"], "left").join(exists, "path", "left")
    problem = (
        F.when((F.col("op") == "create") & F.col("there"), "already_exists")
        .when((F.col("op") != "create") & F.col("there").isNull(), "no_such_file")
        .when((F.col("op") != "create") & F.col("wrong"), "context_mismatch")
        .when((F.col("op") == "delete") & (F.coalesce(text, F.lit("")) != ""), "delete_leaves_lines")
    )
    new_text = F.when(F.col("op") == "create", F.concat(text, F.lit("\n"))).when(F.col("op") == "modify", text)
    return out.select("patch", "path", "op", problem.alias("problem"), F.when(problem.isNull(), new_text).alias("text"))


def verify(applied: DataFrame, files: DataFrame) -> DataFrame:
    """What the applied patches change in ``files`` (path, text), found by reading the changed copy again; refused patches change nothing."""

    def nodes(df: DataFrame) -> DataFrame:
        name = F.element_at(F.split("path", "/", -1), -1)
        return df.select(F.lit("file").alias("kind"), "path", name.alias("name"), F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"), F.sha2("text", 256).alias("blob"))

    done = applied.where("problem IS NULL")
    after = files.select("path", "text").join(done.select("path"), "path", "left_anti").unionByName(done.where("text IS NOT NULL").select("path", "text"))
    return node_diff(nodes(files), nodes(after))


def proposal_entity(proposals: DataFrame, entities: DataFrame, lines: DataFrame) -> DataFrame:
    """(patch, entity, creates) of proposals (patch, reference): the entity (id, path) that is named by id or path; else the file that the patch creates, if
    it does nothing but create and creates exactly that path; else null."""
    known = entities.select("id", F.col("id").alias("reference")).unionByName(entities.select("id", F.col("path").alias("reference"))).groupBy("reference").agg(F.min("id").alias("found"))
    made = lines.groupBy("patch").agg(F.bool_and(F.col("op").eqNullSafe("create") & F.col("problem").isNull()).alias("only"), F.collect_set(F.when(F.col("op") == "create", F.col("path"))).alias("paths"))
    rows = proposals.join(known, "reference", "left").join(made, "patch", "left")
    wanted = F.regexp_replace("reference", "^file:", "")
    creates = F.col("found").isNull() & F.coalesce(F.col("only") & F.array_contains("paths", wanted), F.lit(False))
    return rows.select("patch", F.coalesce("found", F.when(creates, F.concat(F.lit("file:"), wanted))).alias("entity"), creates.alias("creates"))

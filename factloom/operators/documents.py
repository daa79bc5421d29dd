"""Text structure: markdown sections, source windows, comments, excerpts, budgeted gathering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_LIMIT = 65_536


def sections(docs: DataFrame) -> DataFrame:
    """(path, title, level, start, end) of ATX headings outside fences; a section ends where the next begins. Bytes."""
    lines = docs.select("path", F.octet_length("text").cast("long").alias("total"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long"))
    fences = F.coalesce(F.sum(F.when(F.col("line").startswith("```"), 1).otherwise(0)).over(before), F.lit(0))
    heads = lines.withColumn("fences", fences).where((F.col("fences") % 2 == 0) & F.col("line").rlike("^#{1,6} "))
    after = F.lead("start").over(Window.partitionBy("path").orderBy("i"))
    return heads.select(
        "path",
        F.trim(F.regexp_replace("line", "^#+ ", "")).alias("title"),
        F.length(F.regexp_extract("line", "^(#+) ", 1)).cast("long").alias("level"),
        "start",
        F.coalesce(after, "total").alias("end"),
    )


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, start, line) of every line of ``files`` (path, text); start in bytes."""
    rows = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long")
    return rows.select("path", (F.col("i") + 1).cast("long").alias("line_no"), start.alias("start"), "line")


def line_numbers(positions: DataFrame, files: DataFrame) -> DataFrame:
    """``positions`` (id, path, at) with the 1-based line of each byte ``at``: one sweep over the lines' beginnings and the positions of a file."""
    marks = lines(files).select(F.lit(None).cast(positions.schema["id"].dataType).alias("id"), "path", F.col("start").alias("at"), "line_no")
    both = marks.unionByName(positions.select("id", "path", F.col("at").cast("long").alias("at"), F.lit(None).cast("long").alias("line_no")))
    sweep = Window.partitionBy("path").orderBy("at", F.col("line_no").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("line_no", F.max("line_no").over(sweep)).where("id IS NOT NULL")


def source_windows(spans: DataFrame, files: DataFrame, size: int) -> DataFrame:
    """``windows`` with start_line."""
    at = line_numbers(spans.select("id", "path", F.col("lo").alias("at")), files).select("id", F.col("line_no").alias("start_line"))
    return windows(spans, files, size).join(at, "id")


def windows(spans: DataFrame, files: DataFrame, size: int) -> DataFrame:
    """``spans`` (id, path, lo, hi) with w_start, w_end, truncated, window: at most ``size`` bytes from lo on, the end moved back to a
    character border. A file's text meets all of its spans once."""
    size = min(size, WINDOW_LIMIT)
    per = spans.groupBy("path").agg(F.collect_list(F.struct("id", "lo", "hi")).alias("spans"))
    raw = files.join(per, "path").select("path", F.encode("text", "UTF-8").alias("raw"), "spans")

    def window(s: Column) -> Column:
        want = F.least(s.lo + size, s.hi)
        # a byte that continues a character is 10xxxxxx; the end of the span is a border
        inner = lambda at: F.conv(F.hex(F.substring("raw", (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) == 0x80
        end = F.when(want == s.hi, want).otherwise(F.coalesce(*[F.when(~inner(want - k), want - k) for k in range(4)], want))
        return F.struct(s.id.alias("id"), s.lo.alias("w_start"), end.alias("w_end"), (end < s.hi).alias("truncated"), F.decode(F.substring("raw", (s.lo + 1).cast("int"), (end - s.lo).cast("int")), "UTF-8").alias("window"))

    return raw.select("path", F.explode(F.transform("spans", window)).alias("w")).select("path", "w.*")


def frame_offsets(frames: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(id, path, line, column, byte_offset, line_text) of stack frames (id, frame) inside ``root``: where the line begins in bytes, and 200 characters
    of it. A line beyond the file's end begins at its end. Frames without a place, or of no known file, are left out."""
    clean = F.regexp_replace(F.trim(F.col("frame")), r"\)+$", "")
    place = lambda k: F.regexp_extract(clean, r"^(.*):(\d+):(\d+)$", k)
    rows = frames.select("id", F.when(place(1).contains(f"{root}/"), F.substring_index(place(1), f"{root}/", -1)).alias("path"), place(2).cast("long").alias("line"), place(3).cast("long").alias("column"))
    rows = rows.where("path <> '' AND line > 0").join(files.select("path", F.octet_length("text").cast("long").alias("bytes")), "path")
    found = lines(files).select("path", F.col("line_no").alias("line"), "start", F.col("line").alias("text"))
    rows = rows.join(found, ["path", "line"], "left")
    text = F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r$", ""), 1, 200)
    return rows.select("id", "path", "line", "column", F.coalesce("start", "bytes").alias("byte_offset"), text.alias("line_text"))


def leading_comment(before: Column) -> Column:
    """The comment that ends right before a declaration: a block, or the run of // lines; null if there is none."""
    block = F.regexp_extract(before, r"/\*((?:[^*]|\*(?!/))*+)\*/\s*$", 1)
    lines = F.regexp_extract(before, r"((?:(?:^|\n)[ \t]*//[^\n]*)++)\n?[ \t]*$", 1)
    return F.when(block != "", F.trim(block)).when(lines != "", F.trim(F.regexp_replace(lines, r"(?m)^\s*//\s?", "")))


def excerpt(text: Column, lines: int = 12) -> Column:
    """The first lines that are not blank."""
    return F.array_join(F.slice(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), 1, lines), "\n")


def gather(pieces: DataFrame, budget: int) -> DataFrame:
    """Per owner, the pieces (seq, size) admitted in order while they fit; a piece that does not fit is left out whole, a later
    smaller one may still fit."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "size")))
    rows = pieces.groupBy("owner").agg(ordered.alias("all"))
    fold = F.aggregate(
        "all",
        F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"), F.lit("").alias("seqs")),
        lambda a, p: F.when(
            a.used + p.size <= budget,
            F.struct((a.used + p.size).alias("used"), (a.n + 1).alias("n"), F.concat(a.seqs, F.when(a.seqs == "", "").otherwise(","), p.seq.cast("string")).alias("seqs")),
        ).otherwise(a),
    )
    return rows.select("owner", fold.used.alias("used"), fold.n.alias("admitted"), (fold.n < F.size("all")).alias("truncated"), fold.seqs.alias("seqs"))


def prompt(pieces: DataFrame, budget: int) -> DataFrame:
    """Per owner, the text of the admitted pieces (owner, seq, text) in order under their headings, and its bytes by the piece."""
    sized = pieces.withColumn("size", F.octet_length("text").cast("long"))
    kept = gather(sized, budget).select("owner", F.split("seqs", ",").alias("kept"), "truncated")
    rows = sized.join(kept, "owner").where(F.array_contains("kept", F.col("seq").cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text", "size")))
    return rows.groupBy("owner").agg(
        F.array_join(F.transform(ordered, lambda p: F.concat(F.lit("## piece "), p.seq.cast("string"), F.lit("\n"), p.text)), "\n").alias("prompt"), F.sum("size").alias("bytes"), F.first("truncated").alias("truncated")
    )

"""Secret scan with multipart credential linking, in DataFrame functions alone.

Patterns find parts: strong ones (``assign``, ``access``, ``hex``) are reported always; weak ones (account names, opaque
strings, endpoints) only when complementary parts co-occur. A part's neighbours are found by an interval join within its
scope - the document's run of text without a blank line -, done as one sorted sweep: for each class of parts, the nearest
interval that ends before and the nearest that begins after. A weak secret needs an identifier or endpoint within
``reach`` characters, a weak identifier a secret, an endpoint both.

Offsets are code points, end exclusive. Null text is empty; texts and runs of any length are matched whole; each row is a document of
its own even if its doc_id repeats; spans of several kinds may overlap, ties of start go by kind as listed in KINDS; an empty table gives
no rows; further columns are ignored, and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tables import named

REACH = 200
#: kind: (class, strong, pattern, shortest match, group whose length counts). Strong kinds first, in order.
KINDS = {
    "assign": ("secret", True, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    # runs of a class of characters: asking for the least length within the pattern finds the same runs as dropping short ones
    "access": ("identity", True, r"AKIA[A-Z0-9]{16,}", 20, 0),
    "hex": ("secret", True, r"[0-9a-f]{24,}", 24, 0),
    "account": ("identity", False, r"""(?i)(?<![a-z])(user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 3, 2),
    "opaque": ("secret", False, r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}", 20, 0),
    "endpoint": (
        "endpoint",
        False,
        r"""(?:https?|ftp|ssh|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])|(?<![A-Za-z0-9.-])[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++(?<=\.(?:com|net|org|io|dev|cloud|internal))(?![A-Za-z0-9-])""",
        5,
        0,
    ),
}
STRONG = [k for k, v in KINDS.items() if v[1]]
#: A text without any of these has no part that is ever reported: links need a secret.
CANDIDATE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20}"""
SCOPE = r"\n[ \t]*\n"


def _found(kind: str, pattern: str, least: int, group: int) -> Column:
    """Matches of one kind in order: the text before each since the last (lead), its own length, and whether it counts."""
    p = F.lit(pattern)
    gaps = F.split(F.col("text"), pattern, -1)
    whole = F.regexp_extract_all("text", p, F.lit(0))
    value = whole if not group else F.regexp_extract_all("text", p, F.lit(group))
    return F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("all"), value.alias("value")),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(m["gap"]).cast("long").alias("lead"),
            F.length(m["all"]).cast("long").alias("size"),
            (F.length(m["value"]) >= least).alias("ok"),
        ),
    )


def parts(docs: DataFrame) -> DataFrame:
    """(row, kind, start, end) of every part and scope border, and a head for each document: a null kind, doc_id and text."""
    kinds = [(k, p, n, g) for k, (_, _, p, n, g) in KINDS.items()] + [("border", SCOPE, 0, 0)]
    head = F.array(F.lit(None).cast("struct<kind:string,i:int,lead:bigint,size:bigint,ok:boolean>"))
    rows = docs.select("row", "doc_id", "text", F.explode(F.concat(head, *[_found(*k) for k in kinds])).alias("m"))
    is_head = F.col("m").isNull()  # it alone carries what is the document's
    rows = rows.select("row", F.when(is_head, F.col("doc_id")).alias("doc_id"), F.when(is_head, F.col("text")).alias("text"), "m.*").repartition("row")
    run = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("lead") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size"))
    return rows.where("kind IS NULL OR ok").drop("i", "lead", "size", "ok")


def _near(kinds: list[str], reach: int) -> Column:
    """Whether an interval of these kinds lies within ``reach`` in the same scope, before or after in the sweep."""
    scope = Window.partitionBy("row", "scope").orderBy("start", "end", "kind")
    before = F.max(F.when(F.col("kind").isin(kinds), F.col("end"))).over(scope.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("kind").isin(kinds), F.col("start"))).over(scope.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(F.col("start") - before <= reach, F.lit(False)) | F.coalesce(after - F.col("end") <= reach, F.lit(False))


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts to report: the strong, and the weak with their complements."""
    of = {c: [k for k, v in KINDS.items() if v[0] == c] for c in ("secret", "identity", "endpoint")}
    scopes = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = found.withColumn("scope", F.sum(F.when(F.col("kind") == "border", 1).otherwise(0)).over(scopes))
    for c, kinds in of.items():
        swept = swept.withColumn(f"by_{c}", _near(kinds, reach))
    report = (
        F.when(F.col("kind").isin(STRONG), True)
        .when(F.col("kind").isin(of["secret"]), F.col("by_identity") | F.col("by_endpoint"))
        .when(F.col("kind").isin(of["identity"]), F.col("by_secret"))
        .when(F.col("kind").isin(of["endpoint"]), F.col("by_secret") & F.col("by_identity"))
    )
    return swept.where(F.col("kind").isNull() | report)


def _scanned(docs: DataFrame, reach: int) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    span = F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("rank"), "end", "kind"))
    return (
        linked(parts(docs), reach)
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text"), F.array_sort(F.collect_list(span)).alias("spans"))
    )


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row of ``docs``: doc_id and spans (start, rank, end, kind), sorted. Only texts with a candidate are shuffled."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = base.where(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    found = _scanned(some, reach).select("doc_id", "spans")
    none = base.where(~F.col("text").rlike(CANDIDATE)).select("doc_id")
    return found.unionByName(none.withColumn("spans", F.array().cast(found.schema["spans"].dataType)))


def redact(docs: DataFrame, reach: int = REACH, mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every reported span of text replaced by ``mask`` (overlapping ones by one) and n_chars made to fit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = docs.where(~text.rlike(CANDIDATE))
    whole = F.struct(*[named(c).alias(c) for c in docs.columns])
    some = docs.where(text.rlike(CANDIDATE)).select(F.monotonically_increasing_id().alias("row"), whole.alias("whole"), text.alias("text"))
    some = some.withColumn("doc_id", F.col("whole"))  # the row itself takes the id's place
    spans = _scanned_rows(some, reach)
    merged = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.when(s.start < a.to, F.struct(a.out.alias("out"), F.greatest(a.to, s.end).alias("to"))).otherwise(
            F.struct(F.concat(a.out, F.substring(F.col("text"), a.to.cast("int") + 1, (s.start - a.to).cast("int")), F.lit(mask)).alias("out"), s.end.alias("to"))
        ),
    )
    new = F.when(F.size("spans") == 0, F.col("whole.text")).otherwise(
        F.concat(merged.out, F.substring(F.col("text"), merged.to.cast("int") + 1, F.length("text")))
    )
    done = spans.select(
        *[new.alias(c) if c == "text" else F.when(F.size("spans") == 0, F.col("whole").getField(c)).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("whole").getField(c).alias(c) for c in docs.columns]
    )
    return clean.unionByName(done)


def _scanned_rows(docs: DataFrame, reach: int) -> DataFrame:
    """As _scanned, for documents whose doc_id column holds the whole row, which only the head carries on."""
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    span = F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("rank"), "end", "kind"))
    return (
        linked(parts(docs), reach)
        .groupBy("row")
        .agg(F.first("doc_id", ignorenulls=True).alias("whole"), F.max("text").alias("text"), F.array_sort(F.collect_list(span)).alias("spans"))
    )

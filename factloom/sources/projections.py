"""Projections of the driver's tables onto the engine's relations (catalog, symbols, calls, imports, versions, queue, boxes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.times import epoch_us

from factloom.functions.identity import edge_id, symbol_id
from factloom.sources.tables import table

EXTENSIONS = ("js", "ts", "md", "json", "png", "txt")
OVERSIZE = 8000


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document; path, kind, disposition, bytes, blob, text."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    size = F.octet_length("text").cast("long")
    return d.select(
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)).alias("path"),
        F.lit("file").alias("kind"),
        F.when(size > OVERSIZE, "oversize").when(F.col("doc_id") % 17 == 0, "ignored").otherwise("captured").alias("disposition"),
        size.alias("bytes"),
        F.sha2("text", 256).alias("blob"),
        "doc_id",
        "source",
        "lang",
        "text",
    )


def symbols(cat: DataFrame) -> DataFrame:
    """A symbol per non-empty line, with byte offsets; name = first word and length of the line."""
    rows = cat.select("doc_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    # before the lines are dealt by document: who needs no text moves none
    name = F.concat_ws("_", F.substring_index("line", " ", 1), F.length("line").cast("string"))
    rows = rows.withColumns({"size": F.octet_length("line"), "name": name})
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("long"))
    rows = rows.where("size > 0").withColumn("end", F.col("start") + F.col("size"))
    return rows.select("doc_id", "path", F.col("i").cast("long").alias("i"), "start", "end", "name", "line").withColumn(
        "id", symbol_id("path", "start", "end")
    )


def call_sites(sym: DataFrame) -> DataFrame:
    """A call per symbol to the name two symbols on; some to the document's first name, some to a name of the next document, some to no name."""
    order = Window.partitionBy("doc_id").orderBy("i")
    beside = sym.select((F.col("doc_id") - 1).alias("doc_id"), "i", F.col("name").alias("beside"))
    label = (
        F.when(F.col("i") % 7 == 6, "missing?")
        .when(F.col("i") % 5 == 4, F.first("name").over(order))
        .when(F.col("i") % 3 == 1, F.coalesce("beside", F.lit("missing?")))
        .otherwise(F.coalesce(F.lead("name", 2).over(order), F.lit("missing?")))
    )
    sym = sym.join(beside, ["doc_id", "i"], "left")
    return sym.select(
        edge_id("call", "path", "start", "end").alias("id"),
        "doc_id",
        "path",
        "start",
        "end",
        F.col("id").alias("owner"),
        F.col("name").alias("owner_name"),
        label.alias("label"),
        F.when(F.col("i") % 11 == 10, "member").otherwise("identifier").alias("form"),
    )


def imports(cat: DataFrame, n: int) -> DataFrame:
    """Document i imports (7i+3) mod n and, as a type, (11i+5) mod n; every 13th target is unresolved."""
    two = F.array(
        F.struct(F.lit(0).alias("k"), ((F.col("doc_id") * 7 + 3) % n).alias("to")),
        F.struct(F.lit(1).alias("k"), ((F.col("doc_id") * 11 + 5) % n).alias("to")),
    )
    rows = cat.select("doc_id", "path", F.explode(two).alias("x")).select("doc_id", "path", "x.k", "x.to")
    rows = rows.withColumn("to", F.when((F.col("doc_id") + F.col("k")) % 13 != 0, F.col("to")))
    return rows.select(
        F.concat_ws(":", F.lit("import"), "path", F.col("k").cast("string")).alias("id"),
        "doc_id",
        "path",
        F.col("to").alias("target_doc"),
        (F.col("k") == 1).alias("type_only"),
    )


def error_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive users of a day's error events; a dense graph with cycles."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("a"), F.lead("user_id").over(w).alias("b")).where("b IS NOT NULL").distinct()


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customers' nation to the two suppliers' nations that most of its order lines come from; a sparse graph with cycles."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    flows = rows.groupBy(F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return flows.withColumn("place", place).where("place <= 2").select("a", "b")


def versions(cat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two versions of the catalog; B has some documents withdrawn, added, edited and moved."""
    keep = ["doc_id", "path", "blob", "bytes", "text"]
    a = cat.where("doc_id % 10 <> 0").select(*keep)
    text = F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("\nedited"))).otherwise(F.col("text"))
    path = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    b = cat.where("doc_id % 10 <> 1").select("doc_id", path.alias("path"), text.alias("text"))
    b = b.select("doc_id", "path", F.sha2("text", 256).alias("blob"), F.octet_length("text").cast("long").alias("bytes"), "text")
    return a, b


NOW = 1_600_000_000_000


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per event; state by event type, priority from its properties, lease of a minute while running."""
    e = table(spark, sf_dir, "events")
    at = F.floor(epoch_us(F.col("ts")) / 1000)
    state = (
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "running").otherwise("queued")
    )
    return e.select(
        F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.lit("p"), F.col("event_id").cast("string")), 256).alias("id"),
        "event_id",
        F.col("user_id").cast("string").alias("owner"),
        state.alias("state"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("priority"),
        at.alias("created_at"),
        F.when(state == "running", at + 60_000).alias("lease_expires_at"),
        F.when(state == "running", F.concat(F.lit("worker-"), (F.col("event_id") % 4).cast("string"))).alias("lease_holder"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer box per part: id, x, y, w, h."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.cast("long").alias("id"), (k * 37 % 1000).alias("x"), (k * 91 % 1000).alias("y"), (F.col("p_size") % 20 + 5).cast("long").alias("w"), (k % 11 + 4).alias("h")
    )

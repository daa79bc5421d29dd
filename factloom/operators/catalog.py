"""Catalog: directories, dispositions, content-addressed blobs, profile and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.identity import digest
from factloom.functions.text import base_name, is_source, parent


def with_directories(files: DataFrame) -> DataFrame:
    """``files`` (path, kind, disposition, bytes) and a row per directory above them, the root as ''."""
    parts = F.split("path", "/", -1)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = files.select(F.explode(prefixes).alias("path")).distinct()
    dirs = dirs.select("path", F.lit("directory").alias("kind"), F.lit("directory").alias("disposition"), F.lit(0).cast("long").alias("bytes"))
    return files.select("path", "kind", "disposition", "bytes").unionByName(dirs)


def disposition(kind: Column, size: Column, ignored: Column, limit: int) -> Column:
    """How a scan treats an entry; the first rule that holds."""
    return (
        F.when(kind == "directory", "directory")
        .when(ignored, "ignored")
        .when(kind == "symlink", "symlink")
        .when(kind != "file", "special")
        .when(size > limit, "oversize")
        .otherwise("captured")
    )


def check_budget(files: DataFrame, entries: int, total: int) -> None:
    """Refuse a snapshot that is over its limits, with the figures."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n > entries:
        raise ValueError(f"entry_budget: {n} entries, limit {entries}")
    if size > total:
        raise ValueError(f"byte_budget: {size} bytes, limit {total}")


def budget_report(files: DataFrame, by: list[str], entries: int, total: int) -> DataFrame:
    """Per group of ``files`` its entries and bytes, and why a snapshot of it is refused; null if it is within its limits."""
    per = files.groupBy(*by).agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    say = lambda what, n, unit, limit: F.concat(F.lit(f"{what}: "), n.cast("string"), F.lit(f" {unit}, limit {limit}"))
    n, size = F.col("entries"), F.col("bytes")
    return per.withColumn("refused", F.when(n > entries, say("entry_budget", n, "entries", entries)).when(size > total, say("byte_budget", size, "bytes", total)))


def scan_profile(policies: DataFrame) -> DataFrame:
    """One digest of all (path, blob) of the policies: 65,536 buckets by the digest of the path, each digested in path order, then the
    buckets' digests in theirs. No task holds more than a bucket, or a line per bucket."""
    bucket = F.substring(F.sha2("path", 256), 1, 4)
    in_order = lambda a, b: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda p: F.concat_ws("=", p[a], p[b])), "\n")
    parts = policies.groupBy(bucket.alias("bucket")).agg(F.sha2(in_order("path", "blob"), 256).alias("digest"))
    return parts.agg(F.sha2(in_order("bucket", "digest"), 256).alias("scan_profile"))


def blobs(files: DataFrame) -> DataFrame:
    """A row per distinct content: the least path stands for it."""
    return files.groupBy("blob").agg(F.min("path").alias("path"), F.count("*").alias("n_files"), F.max("bytes").alias("bytes"))


def put_blobs(store: DataFrame, files: DataFrame) -> DataFrame:
    """What a put appends to ``store`` (blob, ...): contents it does not hold yet, each once."""
    return files.select("blob", "text", "bytes").dropDuplicates(["blob"]).join(store.select("blob"), "blob", "left_anti")


def corrupt(stored: DataFrame) -> DataFrame:
    """Stored contents whose digest is not their name."""
    return stored.where(F.sha2("text", 256) != F.col("blob"))


def readable_sources(files: DataFrame) -> DataFrame:
    """Captured UTF-8 files that a front-end reads: source files, and package manifests."""
    keep = is_source(F.col("path")) | (base_name(F.col("path")) == "package.json")
    return files.where((F.col("disposition") == "captured") & keep & F.is_valid_utf8("text"))


def nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Directories, files and functions as one relation; a file counts its functions."""
    all_files = with_directories(files)
    per = symbols.groupBy("path").agg(F.count("*").alias("n"))
    is_dir = F.col("kind") == "directory"
    top = all_files.join(per, "path", "left").select(
        F.concat(F.when(is_dir, "dir:").otherwise("file:"), "path").alias("id"),
        "path",
        base_name(F.col("path")).alias("name"),
        "kind",
        F.when(F.col("path") != "", F.concat(F.lit("dir:"), parent(F.col("path")))).alias("parent"),
        F.lit(0).cast("long").alias("start"),
        F.col("bytes").alias("end"),
        F.when(is_dir, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("function_count"),
        "disposition",
    )
    functions = symbols.select(
        "id",
        "path",
        "name",
        F.lit("function").alias("kind"),
        F.concat(F.lit("file:"), "path").alias("parent"),
        "start",
        "end",
        F.lit(0).cast("long").alias("function_count"),
        F.lit("captured").alias("disposition"),
    )
    return top.unionByName(functions)


def counters(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Metadata counters of one version, a single aggregation over each relation."""
    n = node_rows.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "file").alias("files")
    )
    is_call = F.col("kind") == "call_candidate"
    e = edge_rows.agg(
        F.count("*").alias("edges"), F.count_if(is_call).alias("calls"), F.count_if(is_call & F.col("target").isNull()).alias("unresolved_calls")
    )
    return n.crossJoin(e)  # one row by one row


def snapshot_id(files: DataFrame, profile: str) -> DataFrame:
    """The identity of a snapshot: of its scan profile and of all its files."""
    return scan_profile(files).select(digest(F.lit(profile), "scan_profile").alias("snapshot_id"))

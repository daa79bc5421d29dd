"""Language facts: the JSON that front-ends hand in, and a small front-end for the common forms of JavaScript.

The contract is a fixed schema; a document of another schema string is refused by name. The built-in front-end finds declared functions, calls
by name and static imports with SQL patterns; whatever else a file holds is not guessed at: files with dynamic code are flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "factloom.language-facts.v1"
FACTS = """schema STRING, snapshot_id STRING, producer STRING, parsed_files ARRAY<STRING>, dynamic_files ARRAY<STRING>,
 symbols ARRAY<STRUCT<id: STRING, path: STRING, name: STRING, kind: STRING, start: BIGINT, `end`: BIGINT, container: STRING, mutated: BOOLEAN>>,
 calls ARRAY<STRUCT<id: STRING, path: STRING, start: BIGINT, `end`: BIGINT, owner: STRING, label: STRING, form: STRING, target: STRING>>,
 imports ARRAY<STRUCT<id: STRING, path: STRING, specifier: STRING, target_path: STRING, type_only: BOOLEAN>>,
 diagnostics ARRAY<STRUCT<path: STRING, code: STRING, detail: STRING>>"""


def read(spark: SparkSession, path: str, snapshot_id: str) -> dict[str, DataFrame]:
    """Relations of all documents under ``path``; a document of another contract is refused."""
    docs = spark.read.schema(FACTS).json(path)
    wrong = docs.where(~F.col("schema").eqNullSafe(SCHEMA) | ~F.col("snapshot_id").eqNullSafe(snapshot_id)).select("schema", "snapshot_id").first()
    if wrong:
        raise ValueError(f"contract_mismatch: schema {wrong[0]}, snapshot {wrong[1]}")
    out = {k: docs.select(F.explode(k).alias("x")).select("x.*") for k in ("symbols", "calls", "imports", "diagnostics")}
    return out | {k: docs.select(F.explode(k).alias("path")) for k in ("parsed_files", "dynamic_files")}


FUNCTION = r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\("
CALL = r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\("
IMPORT = r"""\bimport\s+(type\s+)?[^'";]*?['"]([^'"]+)['"]"""
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "import", "with")


def _matches(text: str, pattern: str, group: int) -> Column:
    """(lead, whole, name) of each match: the text since the last one, the match and its group."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    return F.arrays_zip(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(whole)).alias("lead"), whole.alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("name"))


def _placed(files: DataFrame, pattern: str, group: int) -> DataFrame:
    rows = files.select("path", F.posexplode(_matches("text", pattern, group)).alias("i", "m")).select("path", "i", "m.*")
    run = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.octet_length("lead") + F.octet_length("whole")).over(run).cast("long"))
    return rows.withColumn("start", F.col("end") - F.octet_length("whole")).drop("lead")


def functions(files: DataFrame) -> DataFrame:
    """Declared functions of source files (path, text): id, path, name, start, end (of the head)."""
    rows = _placed(files, FUNCTION, 1)
    return rows.select(F.concat_ws(":", F.lit("symbol"), "path", F.col("start").cast("string"), F.col("end").cast("string")).alias("id"), "path", "name", "start", "end")


def calls(files: DataFrame) -> DataFrame:
    """Calls by name: id, path, label, start, end, and the declared function that begins last before it (owner)."""
    found = _placed(files, CALL, 1).where(~F.col("name").isin(*KEYWORDS)).select("path", "name", "start", "end", F.lit(1).alias("is_call"), F.lit(None).cast("string").alias("id"))
    heads = functions(files)
    marks = found.unionByName(heads.select("path", "name", "start", "end", F.lit(0).alias("is_call"), "id"))
    w = Window.partitionBy("path").orderBy("start", "is_call").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.withColumn("owner", F.last("id", ignorenulls=True).over(w)).where("is_call = 1")
    rows = rows.join(heads.select("path", "end", F.col("start").alias("head")), ["path", "end"], "left_anti")  # the head itself is no call
    return rows.select(F.concat_ws(":", F.lit("call"), "path", F.col("start").cast("string"), F.col("end").cast("string")).alias("id"), "path", F.col("name").alias("label"), "start", "end", "owner")


def static_imports(files: DataFrame) -> DataFrame:
    """Static imports, with the file that a relative specifier names, if there is one: as it stands, or with a known extension."""
    rows = _placed(files, IMPORT, 2).withColumn("type_only", F.col("whole").rlike(r"\bimport\s+type\s"))
    up = F.regexp_replace("path", "[^/]*$", "")
    joined = F.concat(up, F.regexp_replace("name", r"^\./", ""))
    for _ in range(3):
        joined = F.regexp_replace(joined, r"[^/]+/\.\./", "")
    asks = rows.select("path", F.col("name").alias("specifier"), "start", "type_only", F.when(F.col("name").startswith("."), joined).alias("base"))
    known = files.select(F.col("path").alias("target_path"), F.explode(F.array(F.col("path"), F.regexp_replace("path", r"\.[cm]?[jt]sx?$", ""))).alias("base")).distinct()
    first = known.groupBy("base").agg(F.min("target_path").alias("target_path"))
    out = asks.join(first, "base", "left")
    return out.select(F.concat_ws(":", F.lit("import"), "path", F.col("start").cast("string")).alias("id"), "path", "specifier", "target_path", "type_only")


def dynamic_files(files: DataFrame) -> DataFrame:
    """Files with code that patterns cannot follow."""
    return files.where(F.col("text").rlike(r"\beval\s*\(|\bnew\s+Function\s*\(|\bimport\s*\(|\bwith\s*\(")).select("path")

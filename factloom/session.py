"""Session settings that the engine is tuned for; every one can be overridden by the cluster's own."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "factloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the folder of spark.checkpoint.dir; where that is unset, one is made only if all runs on this machine."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-"))
    return df.checkpoint()


def new_place(spark: SparkSession, name: str) -> str:
    """A new place, in whatever store, below spark.checkpoint.dir, which all executors see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as an operating system's path, below spark.checkpoint.dir, which all executors see."""
    folder = new_place(spark, name)
    if folder.startswith("file:"):
        folder = folder.removeprefix("file:").replace("///", "/")
    if "://" in folder:
        raise ValueError(f"{folder} is no mounted folder")
    return folder


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins that no side of is broadcast: a table's estimated size is that of its compressed files, and the driver would hold its rows many times that large."""
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder of spark.checkpoint.dir: one job, read by column, and safe from lost executors as a checkpoint is. Joins do not broadcast it."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        df.sparkSession.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return shuffled(df.sparkSession.read.schema(df.schema).parquet(path))


#: Rows of a bucket, and of the smallest that are worth a task.
ROWS, FEW = 200_000, 20_000


def buckets(spark: SparkSession, rows: int) -> int:
    """How many buckets so many rows are dealt over: of at most ``ROWS`` each on average, so that a task's memory does not grow with the table."""
    return max(-(-rows // ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // FEW + 1))


@contextmanager
def _held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    was = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _met_in_place(spark: SparkSession) -> AbstractContextManager[None]:
    """Plans made meanwhile join tables that are dealt by some of the join's keys where they lie."""
    return _held(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def grouped_in_memory(spark: SparkSession) -> AbstractContextManager[None]:
    """Lists of groups that are collected meanwhile are kept by key, not sorted first: for buckets of at most ``ROWS`` short rows."""
    return _held(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(ROWS))


def dealt(df: DataFrame, n: int, *keys: str, there: bool = False) -> DataFrame:
    """``df`` (``there``: whose rows already lie as ``repartition(n, *keys)`` puts them) as a table of ``n`` buckets by ``keys`` in the folder of spark.checkpoint.dir, so that what is derived from tables dealt alike, by these keys and others, is
    dealt again without a shuffle. Its name leaves the catalog at once; the rows stay, as those of ``stored`` do."""
    spark = df.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    with _met_in_place(spark):
        (df if there else df.repartition(n, *keys)).write.format("parquet").bucketBy(n, *keys).option("path", new_place(spark, "dealt")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def in_place(df: DataFrame) -> DataFrame:
    """``df``, made of ``dealt`` tables, as a stored table: they meet where they lie."""
    with _met_in_place(df.sparkSession):
        return stored(df)

"""Small JSON stores, and the write path of published versions."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECENT = 8


def recent_projects(projects: DataFrame, n: int = RECENT) -> DataFrame:
    """The last opened projects, each root once."""
    last = projects.groupBy("root").agg(F.max("opened_at").alias("opened_at"))
    return last.orderBy(F.desc("opened_at"), "root").limit(n)


def _file(spark: SparkSession, place: str):
    """(file system, path) of a place, whatever store it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _marker(base: str, analysis_id: str) -> str:
    return f"{base}/_published/analysis={analysis_id}.json"


def publish(rows: dict[str, DataFrame], base: str, analysis_id: str) -> dict[str, int]:
    """Publish the relations of a version under its id, all at once or not at all; the rows of each.

    A publisher writes into a folder of its own. Creating the marker, which names that folder, is the commit: a store creates a file that
    must be new for one publisher only, so of any number that run together one wins, and what the others wrote is removed. An id that is
    published is a conflict, whatever its rows.
    """
    spark = next(iter(rows.values())).sparkSession
    conflict = ValueError(f"conflict: {analysis_id} is published")
    if committed(spark, base, analysis_id):
        raise conflict
    staged = f"{base}/_versions/{uuid.uuid4().hex}"
    try:
        for name, df in rows.items():
            df.write.parquet(f"{staged}/{name}")
        counts = {name: spark.read.parquet(f"{staged}/{name}").count() for name in sorted(rows)}
        _create(spark, _marker(base, analysis_id), json.dumps({"analysis": analysis_id, "folder": staged.rsplit("/", 1)[1], "rows": counts}), conflict)
    except BaseException:
        store, path = _file(spark, staged)
        store.delete(path, True)
        raise
    return counts


def _create(spark: SparkSession, place: str, text: str, conflict: ValueError) -> None:
    """A small file that must be new and is whole once it is there. A lock beside it, which one publisher alone can create, names who may write it;
    a driver that dies between the two leaves a lock that must be removed by hand."""
    store, path = _file(spark, place)
    fresh, lock = (_file(spark, f"{place}.{end}")[1] for end in (uuid.uuid4().hex, "lock"))
    store.mkdirs(path.getParent())
    try:
        if store.getUri().getScheme() == "file":  # its creation by Hadoop looks first and writes then
            os.close(os.open(lock.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        else:
            store.create(lock, False).close()
    except FileExistsError:
        raise conflict from None
    except Py4JJavaError:
        if store.exists(lock):
            raise conflict from None
        raise
    out = store.create(fresh, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not store.rename(fresh, path):
        raise OSError(f"{place} could not be written")


def marker(spark: SparkSession, base: str, analysis_id: str) -> dict:
    """What was published under an id: its folder, and the rows of each relation."""
    if not committed(spark, base, analysis_id):
        raise ValueError(f"not_found: {analysis_id}")
    return json.loads(spark.read.text(_marker(base, analysis_id), wholetext=True).first()[0])


def committed(spark: SparkSession, base: str, analysis_id: str) -> bool:
    store, path = _file(spark, _marker(base, analysis_id))
    return store.exists(path)


def load(spark: SparkSession, base: str, analysis_id: str, name: str) -> DataFrame:
    """A relation of a published version: the files of one publisher are read."""
    return spark.read.parquet(f"{base}/_versions/{marker(spark, base, analysis_id)['folder']}/{name}")


def versions(spark: SparkSession, base: str) -> DataFrame:
    """analysis, relation, n of all that is published."""
    found = spark.read.schema("analysis string, rows map<string, long>").option("pathGlobFilter", "*.json").json(f"{base}/_published")
    return found.select("analysis", F.explode("rows").alias("relation", "n"))

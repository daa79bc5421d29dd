"""Scanning a folder tree that all executors see (a shared mount): listing, capture of contents, and the catalog of a snapshot.

``tree`` lists in rounds: a task lists the directories it was given, breadth first, and goes on into those below until its room is used up; what it
has not listed comes back as pending rows and is dealt out anew, so a subtree of any size is shared by all tasks and no list passes
through the driver. Links are recorded, never followed. ``TreeSource`` is the same listing as a data source, ``spark.read.format("tree")``:
a partition per batch of directories, a filter on the begin of the path prunes the walk.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from factloom.functions.text import base_name
from factloom.operators import catalog, ignore
from factloom.session import checkpointed

#: Directories that no scan enters.
BUILTIN = (".git", "node_modules", "target")
#: Directories that a task lists in a round before it hands back the rest; the first rounds hand back sooner.
ROOM = 4_096
POLICY = ".gitignore"
SCHEMA = "path string, kind string, bytes long, detail string"


def _children(root: str, directory: str) -> list[tuple[str, str, int, str | None]] | None:
    """(path, kind, bytes, detail) of the entries of one directory in order of their names; None if it cannot be read."""
    try:
        with os.scandir(os.path.join(root, directory)) as found:
            names = sorted(found, key=lambda e: os.fsencode(e.name))
    except OSError:
        return None
    out = []
    for e in names:
        path = f"{directory}/{e.name}" if directory else e.name
        if "\\" in path:
            raise ValueError(f"backslash_filename_not_supported: {path!r}")
        try:
            path.encode()
        except UnicodeEncodeError:
            raise ValueError(f"non_utf8_path_not_supported: {path!r}") from None
        if e.is_symlink():
            target = os.readlink(os.path.join(root, path))
            out.append((path, "symlink", 0, "link_not_followed;target_hash:" + hashlib.sha256(os.fsencode(target)).hexdigest()))
        elif e.is_dir(follow_symlinks=False):
            out.append((path, "directory", 0, None))
        elif e.is_file(follow_symlinks=False):
            out.append((path, "file", e.stat(follow_symlinks=False).st_size, None))
        else:
            out.append((path, "special", 0, None))
    return out


def _meets(path: str, under: str) -> bool:
    """Whether a path or something below it can begin with ``under``."""
    return path.startswith(under) or under.startswith(f"{path}/" if path else "")


def walk(root: str, starts: list[str], room: int | None = None, under: str = "") -> Iterator[tuple[str, str | None, int, str | None]]:
    """Entries of the directories ``starts`` and of all below, breadth first; kind None: a directory that is left to another task."""
    queue, listed = deque(starts), 0
    while queue:
        directory = queue.popleft()
        if room is not None and listed >= room:
            yield directory, None, 0, None
            continue
        listed += 1
        found = _children(root, directory)
        if directory.startswith(under):
            yield directory, "directory", 0, None if found is not None else "directory_not_enumerated"
        for entry in found or ():
            path, kind = entry[:2]
            if kind == "directory" and path.rsplit("/", 1)[-1] not in BUILTIN:
                if _meets(path, under):
                    queue.append(path)
            elif path.startswith(under):
                yield entry


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def tree(spark: SparkSession, root: str, under: str = "", room: int = ROOM) -> DataFrame:
    """path, kind, bytes, detail of every entry below ``root`` (itself as ''), below directories that no scan enters excepted."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("detail", pa.string())])

    def listing(share: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts = [p for b in batches for p in b.column("path").to_pylist()]
            yield from _batches(walk(root, starts, share, under), schema)

        return run

    pending, rounds, share = spark.createDataFrame([("",)], "path string"), [], 16
    while True:
        found = checkpointed(pending.mapInArrow(listing(min(room, share)), SCHEMA))
        rounds.append(found.where("kind IS NOT NULL"))
        left = found.where("kind IS NULL").select("path")
        n = left.count()
        if not n:
            break
        # about sixteen directories to a task at first, then as many as there are tasks
        pending, share = left.repartition(max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))), "path"), share * 8
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def capture(files: DataFrame, root: str, limit: int) -> DataFrame:
    """path, content of ``files`` (path); content is null where a file cannot be read, is no plain file, changes while it is read, or is larger than ``limit``."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def read(path: str) -> bytes | None:
        try:
            handle = os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW)
        except OSError:
            return None
        with os.fdopen(handle, "rb") as f:
            before = os.fstat(handle)
            if not stat.S_ISREG(before.st_mode) or before.st_size > limit:
                return None
            content = f.read(limit + 1)
            after = os.fstat(handle)
        same = (before.st_size, before.st_mtime_ns, before.st_ino) == (after.st_size, after.st_mtime_ns, after.st_ino)
        return content if same and len(content) == before.st_size else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(((p, read(p)) for p in b.column("path").to_pylist()), schema, 64)

    return files.select("path").mapInArrow(run, "path string, content binary")


def _above(path: Column) -> Column:
    """The directories above a path, the root excepted."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(spark: SparkSession, root: str, max_file_bytes: int, max_entries: int | None = None, max_total_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, contents) of a snapshot: path, kind, disposition, bytes, blob, detail in order of the path, and the captured contents as blob, path, content.

    Policies of all directories above hold; what lies below an ignored directory is no part of the snapshot. A breach of a budget refuses the whole of it.
    """
    listed = tree(spark, root)
    policies = capture(listed.where((F.col("kind") == "file") & (base_name(F.col("path")) == POLICY)), root, max_file_bytes)
    rule_rows = checkpointed(ignore.rules(policies.select("path", F.col("content").cast("string").alias("text"))))
    plain = listed.where("kind <> 'symlink'")  # links are recorded whatever a rule says
    hidden = checkpointed(ignore.ignored(plain, rule_rows).where("ignored AND path <> ''").select("path"))
    inside = listed.where("instr(path, '/') > 0").select("path", F.explode(_above(F.col("path"))).alias("dir"))
    below = inside.join(hidden.select(F.col("path").alias("dir")), "dir", "left_semi").select("path").distinct()
    kept = listed.join(below, "path", "left_anti").join(hidden.withColumn("ignored", F.lit(True)), "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
    plain_file = (F.col("kind") == "file") & ~F.col("ignored")
    read = checkpointed(capture(kept.where(plain_file & (F.col("bytes") <= max_file_bytes)), root, max_file_bytes).withColumn("blob", F.sha2("content", 256)))
    rows = kept.join(read.select("path", "blob", F.octet_length("content").cast("long").alias("size")), "path", "left")
    builtin = base_name(F.col("path")).isin(*BUILTIN)
    disposition = (
        F.when(F.col("kind") == "symlink", "symlink")
        .when(F.col("ignored"), "ignored")
        .when(F.col("kind") == "directory", F.when(F.col("detail").isNotNull(), "unreadable").otherwise("directory"))
        .when(F.col("kind") == "special", "special")
        .when(F.col("bytes") > max_file_bytes, "oversize")
        .when(F.col("blob").isNull(), "unstable_or_unreadable")
        .otherwise("captured")
    )
    why = (
        F.when(F.col("ignored"), F.when(builtin, "builtin_or_store_boundary").otherwise("gitignore_boundary"))
        .when(F.col("disposition") == "oversize", "file_byte_limit")
        .when(F.col("disposition") == "unstable_or_unreadable", "source_not_captured")
        .otherwise(F.col("detail"))
    )
    entries = rows.withColumn("disposition", disposition).withColumn("detail", why).withColumn("bytes", F.coalesce("size", "bytes"))
    entries = checkpointed(entries.select("path", "kind", "disposition", "bytes", "blob", "detail"))
    if max_entries is not None or max_total_bytes is not None:
        captured = F.when(F.col("disposition") == "captured", F.col("bytes")).otherwise(0)
        most = 2**63 - 1
        catalog.check_budget(entries.withColumn("bytes", captured), most if max_entries is None else max_entries, most if max_total_bytes is None else max_total_bytes)
    return entries.orderBy("path"), read.where("blob IS NOT NULL").select("blob", "path", "content")


def write_tree(rows: DataFrame, root: str) -> None:
    """Files of ``rows`` (path, text, link) below ``root``: a link to ``link`` where that is not null. A task that is repeated writes the same."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text, link in zip(*(b.column(c).to_pylist() for c in ("path", "text", "link")), strict=True):
                place = os.path.join(root, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                fresh = f"{place}.{os.getpid()}.part"
                if link is not None:
                    os.symlink(link, fresh)
                else:
                    with open(fresh, "wb") as f:
                        f.write((text or "").encode())
                os.replace(fresh, place)
            yield b.select(["path"])

    rows.select("path", "text", "link").mapInArrow(put, "path string").count()


class Batch(InputPartition):
    """Directories of one task: with all below them, or their own entries alone."""

    def __init__(self, directories: list[str], deep: bool) -> None:
        super().__init__(0)
        self.directories, self.deep = directories, deep


class TreeSource(DataSource):
    """``spark.read.format("tree").option("path", root).option("partitions", 64).load()``; see ``register``."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ARG002
        return TreeReader(self.options["path"], int(self.options.get("partitions", 64)))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, wanted: int) -> None:
        self.root, self.wanted, self.under = root, wanted, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes the begin of a path, or a whole path, to prune by; Spark filters again but for the begin."""
        for f in filters:
            if isinstance(f, StringStartsWith | EqualTo) and f.attribute == ("path",) and (self.under.startswith(f.value) or f.value.startswith(self.under)):
                self.under = max(self.under, f.value, key=len)
                if isinstance(f, StringStartsWith):
                    continue
            yield f

    def partitions(self) -> list[Batch]:
        """Directories are listed here, breadth first, until there are enough to share out; their entries are listed by tasks."""
        queue, above = deque([""]), []
        while queue and len(queue) < self.wanted and len(above) < self.wanted:
            directory = queue.popleft()
            above.append(directory)
            for path, kind, *_ in _children(self.root, directory) or ():
                if kind == "directory" and path.rsplit("/", 1)[-1] not in BUILTIN and _meets(path, self.under):
                    queue.append(path)
        below = list(queue)
        size = max(1, -(-len(below) // self.wanted))
        return [Batch([d], False) for d in above] + [Batch(below[i : i + size], True) for i in range(0, len(below), size)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if partition.deep:
            yield from walk(self.root, partition.directories, under=self.under)
            return
        for directory in partition.directories:  # its own entries, without the directories that are listed for themselves
            first = walk(self.root, [directory], room=1, under=self.under)
            yield from (e for e in first if e[1] is not None)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let its filters be pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)

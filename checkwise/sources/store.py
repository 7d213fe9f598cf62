"""Materialised tables in the shared work folder.

A derived table that many queries read (the fact table) is written once as
parquet under ``spark.checkpoint.dir`` and read back by every later query.
The folder is keyed by the inputs' paths, sizes and modification times, so a
changed input gets a new table. The parquet committer writes ``_SUCCESS`` last,
so a half-written folder is never read; a lost executor only re-runs its task.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from checkwise.session import shuffles_freed, work_dir

_LAYOUT_VERSION = "v2"
#: Tables derived from fewer bytes are dealt evenly to the cores when written.
SPREAD_BELOW = 32 << 20
#: Of the parquet files in the work folder.
COMPRESSION = "zstd"
_CODE_HASH: str | None = None
# Resolved read-back frames of finished tables, per session and path. A
# finished table never changes (its key changes instead), so the file listing
# is done once per session, as a catalog would cache it.
_RESOLVED: dict[tuple[int, str], DataFrame] = {}


def _code_hash() -> str:
    """Hash of the package source: a derived table built by older code is
    never read back by newer code."""
    global _CODE_HASH
    if _CODE_HASH is None:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        h = hashlib.sha1()
        for dirpath, _dirs, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    with open(os.path.join(dirpath, f), "rb") as fh:
                        h.update(f.encode() + fh.read())
        _CODE_HASH = h.hexdigest()[:12]
    return _CODE_HASH


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return bool(fs.exists(p))


def _publish(spark: SparkSession, staging: str, path: str) -> None:
    fs, src = _hadoop_path(spark, staging)
    _, dst = _hadoop_path(spark, path)
    if not fs.exists(dst):
        fs.rename(src, dst)


def input_key(spark: SparkSession, paths: list[str]) -> str:
    """Stable key of a set of inputs: path, length and modification time of
    every file below them, listed through Hadoop, so it holds on any store and
    changes when a file is appended to a partitioned folder."""
    files = []
    for path in paths:
        fs, p = _hadoop_path(spark, path)
        listing = fs.listFiles(p, True)
        while listing.hasNext():
            f = listing.next()
            files.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
    h = hashlib.sha1((_LAYOUT_VERSION + _code_hash()).encode())
    h.update("\n".join(sorted(files)).encode())
    return h.hexdigest()[:16]


def _input_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Bytes of the files that ``df`` is computed from."""
    total = 0
    for path in df.inputFiles():
        fs, p = _hadoop_path(spark, path)
        total += fs.getFileStatus(p).getLen()
    return total


def materialize(spark: SparkSession, name: str, key: str, build,
                partition_by: list[str] | None = None,
                sort_within: list[str] | None = None,
                schema=None, spread: bool = True) -> DataFrame:
    """Return the table ``name`` for ``key``, building it with ``build()`` once.

    ``build`` returns the DataFrame to write. Writes are range-partitioned on
    the partition and sort columns so each task writes a few contiguous files
    (no one-task-per-month skew), sorted so parquet min/max stats skip row
    groups for date and room predicates."""
    path = f"{work_dir(spark)}/tables/{name}-{key}"
    cached = _RESOLVED.get((id(spark), path))
    if cached is not None and cached.sparkSession is spark:
        return cached
    if not exists(spark, f"{path}/_SUCCESS"):
        df = build()
        order = (partition_by or []) + (sort_within or [])
        if order:
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        elif spread and _input_bytes(spark, df) < SPREAD_BELOW:
            # spread rows over at least one file per core so later scans of
            # a small derived input are not a single task; a large one has
            # enough tasks, and would be sorted and shuffled whole for nothing
            df = df.repartition(max(spark.sparkContext.defaultParallelism, 1))
        # write to a private staging folder, then publish it with one rename:
        # readers never see a half-written table, and when two builders race
        # the first rename wins and the other simply reads that table
        staging = f"{path}.staging-{uuid.uuid4().hex[:12]}"
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        with shuffles_freed(spark):
            w.option("compression", COMPRESSION).parquet(staging)
        _publish(spark, staging, path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    _RESOLVED[(id(spark), path)] = df
    return df


def materialize_text(spark: SparkSession, name: str, key: str, build) -> str:
    """The folder of text files ``name`` for ``key``, written once. ``build()`` returns (folder, row, value): the lines of
    each folder's one file, in the order of ``row``."""
    path = f"{work_dir(spark)}/tables/{name}-{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        staging = f"{path}.staging-{uuid.uuid4().hex[:12]}"
        files = build().repartition("folder").sortWithinPartitions("folder", "row").select("folder", "value")
        with shuffles_freed(spark):
            files.write.partitionBy("folder").text(staging)
        _publish(spark, staging, path)
    return path


def materialize_lines(spark: SparkSession, name: str, key: str, build, records: int) -> str:
    """The folder of text files ``name`` for ``key``, written once: the rows of each partition of ``build()`` (value), in
    their order, ``records`` to a file."""
    path = f"{work_dir(spark)}/tables/{name}-{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        staging = f"{path}.staging-{uuid.uuid4().hex[:12]}"
        with shuffles_freed(spark):
            build().write.option("maxRecordsPerFile", records).text(staging)
        _publish(spark, staging, path)
    return path


def stored_copy(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, computed once and read back from a fresh folder under the shared work folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared work folder (for snapshots, staging)."""
    return f"{work_dir(spark)}/scratch/{name}-{uuid.uuid4().hex[:12]}"

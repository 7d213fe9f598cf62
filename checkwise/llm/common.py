"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of every word rule in this folder.
SPACES = " \t\n\x0b\x0c\r"

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_checkwise_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="checkwise-py-"), "checkwise_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._checkwise_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared ``spark.checkpoint.dir``.

    Only where that setting is unset and the master is local (tests) is a
    private folder made; on a cluster an unset setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_checkwise_scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = spark.sparkContext._checkwise_scratch = tempfile.mkdtemp(prefix="checkwise-llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand freed memory that Arrow and the C library still hold back to the system: a Python worker that waits for its next
    task would keep it, beside the memory of the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def hash128(col, salt: str = "") -> list:
    """Two independently seeded 64-bit hashes of a column."""
    return [F.xxhash64(col), F.xxhash64(F.lit(f"second{salt}"), col)]

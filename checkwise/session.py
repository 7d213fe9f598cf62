"""Session helpers: building a local session for tests/bench and locating the
shared work folder (``spark.checkpoint.dir``) used for materialised tables."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "checkwise", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, use the cluster's
    own session; nothing in the library depends on these settings."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.driver.memory", "16g"))
    for k, v in {**_DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A write that runs in here drops its shuffle files when it ends; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and must be a shared filesystem.
    Only when it is unset (local tests) a private folder is created and
    registered, so ``DataFrame.checkpoint()`` and materialised tables agree."""
    conf = spark.sparkContext.getConf()
    d = conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            d = None
    if not d:
        d = getattr(spark, "_checkwise_work_dir", None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a shared "
                             "folder (derived tables and checkpoints are written there)")
        d = tempfile.mkdtemp(prefix="checkwise-work-")
        spark.sparkContext.setCheckpointDir(d)
        spark._checkwise_work_dir = d  # type: ignore[attr-defined]
    elif spark.sparkContext.getCheckpointDir() is None:
        # configured but not registered with this context: checkpoint() needs it
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")

"""B1 dated snapshots (the daily backup), as gzip parquet under
``<base>/snapshot_date=YYYY-MM-DD/<table>``, their check and their restore.

``write_committed`` copies all tables of a store as of one committed version, so
loads that run meanwhile don't show. Beside the tables it writes a digest of
every file (rows, and an order-free sum of row hashes); ``verify`` computes the
digests again and ``restore`` loads a verified snapshot into an empty store with
one commit.

Each table is written by its own partitions (no coalesce to one file); the
parquet committer publishes a table folder only when all tasks succeeded.
Retention (deleting old snapshots) is left to the storage's lifecycle rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkwise.sources.commitlog import CommitLog

DIGESTS = "_digests"


def snapshot_path(base: str, day: dt.date, table: str) -> str:
    return f"{base.rstrip('/')}/snapshot_date={day.isoformat()}/{table}"


def write_snapshot(tables: dict[str, DataFrame], base: str, day: dt.date) -> dict[str, str]:
    paths = {}
    for name, df in tables.items():
        p = snapshot_path(base, day, name)
        df.write.mode("overwrite").option("compression", "gzip").parquet(p)
        paths[name] = p
    return paths


def read_snapshot(spark: SparkSession, base: str, day: dt.date, table: str) -> DataFrame:
    return spark.read.parquet(snapshot_path(base, day, table))


def file_digests(spark: SparkSession, base: str, day: dt.date, table: str) -> DataFrame:
    """(table_name, file, n_rows, digest) of a snapshot table; the digest does not depend on the order of rows."""
    df = read_snapshot(spark, base, day, table)
    name = F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file")
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns])
    return (df.select(name, row.cast("decimal(38,0)").alias("h")).groupBy("file")
            .agg(F.count("*").alias("n_rows"), F.sum("h").cast("string").alias("digest"))
            .select(F.lit(table).alias("table_name"), "file", "n_rows", "digest"))


def _digests(spark: SparkSession, base: str, day: dt.date, tables: list[str]) -> DataFrame:
    out = file_digests(spark, base, day, tables[0])
    for table in tables[1:]:
        out = out.unionByName(file_digests(spark, base, day, table))
    return out


def write_committed(log: CommitLog, base: str, day: dt.date, version: int | None = None) -> dict[str, str]:
    """All tables of a store as of one version (the newest when it starts), with their digests."""
    version = log.head() if version is None else version
    tables = sorted({p.table for p in log.state(version).parts})
    if not tables:
        return {}
    paths = write_snapshot({t: log.read(t, version) for t in tables}, base, day)
    _digests(log.spark, base, day, tables).write.mode("overwrite").parquet(snapshot_path(base, day, DIGESTS))
    return paths


def verify(spark: SparkSession, base: str, day: dt.date) -> DataFrame:
    """The files whose rows are not what was written (missing, added or changed): (table_name, file)."""
    written = spark.read.parquet(snapshot_path(base, day, DIGESTS))
    tables = [r.table_name for r in written.select("table_name").distinct().collect()]
    now = _digests(spark, base, day, tables)
    both = written.withColumn("was", F.lit(1)).unionByName(now.withColumn("was", F.lit(0)))
    return (both.groupBy("table_name", "file", "n_rows", "digest").agg(F.count_distinct("was").alias("n"))
            .filter("n < 2").select("table_name", "file").distinct())


def restore(log: CommitLog, base: str, day: dt.date) -> int:
    """Load a snapshot into a store with one commit, in place of what its tables hold; the new version."""
    bad = verify(log.spark, base, day).limit(10).collect()
    if bad:
        raise ValueError(f"damaged snapshot: {[tuple(r) for r in bad]}")
    written = log.spark.read.parquet(snapshot_path(base, day, DIGESTS))
    load = log.begin(f"restore-{day.isoformat()}")
    rows = 0
    for r in written.groupBy("table_name").agg(F.sum("n_rows").alias("n")).collect():
        df = read_snapshot(log.spark, base, day, r.table_name).drop("load_id")
        load.write(r.table_name, df, ("entry_month",) if {"entry_month", "entry_date"} <= set(df.columns) else (), replace=True)
        if "id" in df.columns and "entry_date" in df.columns:
            rows = df.agg(F.max("id")).first()[0] or 0
    if rows:
        load.reserve_ids(rows)  # later loads number on from the restored ids
    return load.commit()

"""Distributed row numbering (no single-partition window, no driver loop).

``with_row_number`` numbers rows 1..N in a total order:
range-partitioned sort -> per-partition counts (one row per partition) ->
running offsets over that small table -> join back. The sorted, id-tagged
rows are written to ``spark.checkpoint.dir`` first (as parquet: in one pass,
compressed, and the counts read two columns only) so both uses see the same
partitioning (and a lost executor cannot renumber anything).

``number_lines`` numbers the lines of text files in file order, per file:
the position inside a split comes from ``monotonically_increasing_id`` (rows of
one split are contiguous and ordered inside a task), the split's offset from
the line counts of the earlier splits of the same file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checkwise.session import shuffles_freed, work_dir


def in_order(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` sorted, each row with its partition and place: what ``numbered`` takes once it was written and read back."""
    return (df.orderBy(*order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id()))


def with_row_number(df: DataFrame, order: list[Column | str], name: str = "row_no") -> DataFrame:
    spark = df.sparkSession
    path = f"{work_dir(spark)}/scratch/numbered-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        in_order(df, order).write.option("compression", "zstd").parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_mid", T.LongType())])
    return numbered(spark.read.schema(schema).parquet(path), name)


def numbered(tagged: DataFrame, name: str = "row_no") -> DataFrame:
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # one row per partition: bounded by the partition count, safe to broadcast
    return (tagged.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
            .withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
            .drop("_pid", "_mid", "_off", "_first"))


def number_lines(lines: DataFrame, file_col: str = "file_path", block_col: str = "block_start",
                 name: str = "line_no") -> DataFrame:
    """``lines`` as produced by ``spark.read.text`` with the file path and split
    start attached; adds 1-based ``name`` counting every line of each file."""
    tagged = lines.withColumn("_mid", F.monotonically_increasing_id())
    blocks = tagged.groupBy(file_col, block_col).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = (Window.partitionBy(file_col).orderBy(block_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # one row per split: bounded by (input size / split size)
    return (tagged.join(offsets.select(file_col, block_col, "_off", "_first"), [file_col, block_col])
            .withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
            .drop("_mid", "_off", "_first"))

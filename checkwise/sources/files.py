"""Readers for the raw input files.

* submissions: JSON Lines, one request body per line (``value``), or a table
  with ``seq/payload/submitted_by/ip`` columns.
* history: JSON Lines, or files that hold one JSON array each. Both are read by
  as many tasks as their bytes call for (``operators/records``).
* CSV: records as the reference's reader counts them (the header is record 1,
  blank lines count), also with line breaks inside quoted cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkwise.operators.records import csv_format, first_lines, read_elements, read_records

_BOM = "^\ufeff"
_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def read_history_array(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one JSON array of records each -> one row per record (value = its text without white space outside
    strings, keys in their order)."""
    # what stands before the first record is "[", what stands behind the last "]": both at the array's edge, and only there
    inner, edges = read_elements(spark, path)
    bare = lambda c: F.regexp_replace(c, r"\A[\s\x{feff}]+|\s+\z", "")
    text = bare(F.col("value"))
    text = F.when(F.col("first"), F.regexp_replace(text, r"\A\[", "")).otherwise(text)
    text = F.when(F.col("last"), F.regexp_replace(text, r"\]\z", "")).otherwise(text)
    edges = edges.select(F.regexp_replace(bare(text), _STRING + r"|\s+", "$1").alias("value"))
    return inner.unionByName(edges).where(F.col("value") != "")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Records of headered CSV files: (file_path, line_no, value); record 1 of each file is its header."""
    return read_records(spark, path, csv_format()).select(
        "file_path", F.col("record_no").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def csv_header(lines: DataFrame) -> str:
    """The header shared by all files of a CSV import (one row per file is
    collected; differing headers are an error)."""
    heads = [r[0] for r in lines.where(F.col("line_no") == 1).select(F.regexp_replace("value", _BOM, "")).distinct().collect()]
    if not heads:
        raise ValueError("Empty CSV")
    if len(heads) > 1:
        raise ValueError(f"CSV files disagree on the header: {heads}")
    return heads[0]


def read_csv_header(spark: SparkSession, path: str, lines: DataFrame) -> str:
    """``csv_header`` of the records ``lines`` below ``path``, from the files' first lines alone if these are whole records."""
    heads = first_lines(spark, path).distinct().collect()
    if any(r.open for r in heads):
        return csv_header(lines)
    first = spark.createDataFrame([(1, r.value) for r in heads], "line_no long, value string")
    return csv_header(first.withColumn("value", F.regexp_replace("value", "\r$", "")))


def csv_data_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line_no") > 1)

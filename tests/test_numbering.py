"""Distributed numbering matches a sequential count."""
from pyspark.sql import functions as F

from checkwise.operators.numbering import with_row_number


def test_with_row_number_total_order(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = sorted((r.k, r.n) for r in with_row_number(df, ["k"], "n").collect())
    assert got == [(k, k + 1) for k in range(5000)]


def test_number_lines_across_many_splits_and_files(spark):
    """Per-file line numbers stay exact when files are cut into many splits and
    several splits/files share a task."""
    import os
    import tempfile

    from checkwise.sources import files

    d = tempfile.mkdtemp(prefix="checkwise-lines-")
    want = {}
    for f in range(3):
        lines = [f"f{f},{i}," + "x" * (i % 37) for i in range(1, 2001)]
        lines[100] = ""          # blank lines count too
        lines[500] = ",,,,"
        with open(os.path.join(d, f"part-{f}.csv"), "w") as fh:
            fh.write("\n".join(lines) + "\n")
        want.update({(f"part-{f}.csv", n + 1): v for n, v in enumerate(lines)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {(r.file_path.rsplit("/", 1)[-1], r.line_no): r.value
               for r in files.read_csv_text(spark, d).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want

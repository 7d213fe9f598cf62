"""The derived inputs move their rows no more often than they must."""
import datetime as dt
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from checkwise.plans import ingest
from checkwise.sources import files, raw, store
from checkwise.sources import testdata as td


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_submissions_read_the_lines_once(spark, sf_small):
    """The repeated items are made of an order's lines where they met, not by a second join of all lines."""
    plan = _plan(raw.build_submissions(spark, sf_small))
    assert plan.count("l_returnflag") and sum("FileScan" in x and "lineitem" in x for x in plan.splitlines()) == 1


def test_lines_meet_the_wide_text_last(spark, sf_small):
    """The indicators' text joins behind the orders, so it isn't shuffled for them."""
    plan = raw._lines_with_context(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert "_iid" in joins[0]
    plan = td.entries_unmaterialised(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("o_custkey" in x and "l_partkey" in x for x in plan.splitlines() if "Join" in x) == 0


def test_large_tables_are_written_as_they_come(spark, tmp_path, monkeypatch):
    """A table of large input isn't dealt out (sorted and shuffled) once more before it is written."""
    spark.range(1000).repartition(3).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(store, "SPREAD_BELOW", 0)
    build = lambda: spark.read.parquet(f"{tmp_path}/in").coalesce(2)
    out = store.materialize(spark, "spread_test", tmp_path.name, build)
    assert out.count() == 1000 and len(glob.glob(f"{store.work_dir(spark)}/tables/spread_test-{tmp_path.name}/*.parquet")) == 2


# --- on tables of their own: repeated keys, nulls, lines without a partner ------


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    day = dt.datetime(1996, 1, 20)

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")

    put("region", [(i, n) for i, n in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])], "r_regionkey long, r_name string")
    put("nation", [(i, f"N{i}", i % 5) for i in range(6)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(i, f"C{i}", i % 7) for i in range(20)], "c_custkey long, c_name string, c_nationkey int")
    put("supplier", [(i, f"S{i}", i % 6, 1.0) for i in range(15)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    put("part", [(i, f"p {i}", f"Brand#{i % 3}", "SMALL", i % 9) for i in range(30)] * 2,
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    put("orders", [(i, i % 23, day + dt.timedelta(days=i), f"{i % 5 + 1}-X") for i in range(120)] + [(40, 3, day, "1-X"), (50, 3, None, "1-X")],
        "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    put("lineitem", [(i % 130, (i * 7) % 33, None if i % 19 == 0 and i * 7 % 33 % 9 % 5 else i % 15, i % 4 + 1, float(i % 5), "RAN"[i % 3]) for i in range(520)]
        + [(None, 1, 1, 1, 1.0, "R"), (10, 3, 3, 1, 1.0, "R"), (10, 3, 3, 1, 1.0, "R")],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string")
    return d


def _rows(df):
    return sorted(map(str, df.collect()))


def _tables(spark, name):
    return {os.path.basename(p) for p in glob.glob(f"{store.work_dir(spark)}/tables/{name}-*")}


def test_stored_tables_come_without_the_fact_table(spark, odd):
    """the stored tables hold the rows of every tenth order, and the other nine tenths aren't joined and written for them."""
    before = _tables(spark, "kpi_entries")
    found = raw.stored_entries(spark, odd), raw.stored_presence(spark, odd), raw.stored_batch_index(spark, odd)
    assert _tables(spark, "kpi_entries") == before
    entries = td.kpi_entries(spark, odd).where(F.substring("batch_id", 3, 30).try_cast("long") % raw.STORED_EVERY == 0)
    # lines with equal keys are interchangeable: which of their ids a row has is not defined
    assert entries.count() > 20 and found[0].columns == entries.columns
    assert _rows(found[0].drop("id", "comment", "check_value", "earned_points")) == _rows(entries.drop("id", "comment", "check_value", "earned_points"))
    assert _rows(found[0].select("id")) == _rows(entries.select("id"))
    assert _rows(found[1]) == _rows(entries.select("batch_id", "staff_id").distinct())
    assert _rows(found[2]) == _rows(entries.select("batch_id", "entry_month").distinct())


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    """shuffle files go when the table they served is written."""
    before = _shuffle_files(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    store.materialize(spark, "freed_test", tmp_path.name, lambda: spark.range(5000).repartition(7, "id").groupBy("id").count())
    store.stored_copy(spark.range(5000).repartition(7, "id"), "freed_test")
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before and spark.conf.get(key) == "false"


def test_csv_lines_are_written_once(spark, odd):
    """the texts are kept once, in order and without their sort keys; line numbers and blank lines are made as they are read."""
    scratch = f"{store.work_dir(spark)}/scratch/numbered-*"
    before = set(glob.glob(scratch))
    lines = raw.csv_lines(spark, odd).orderBy("line_no").collect()
    assert set(glob.glob(scratch)) == before
    data = raw._lines_with_context(spark, odd).orderBy(*td.LINE_KEY).collect()
    assert len(data) > 2 * raw.CSV_BLANK_EVERY
    assert [r.line_no for r in lines] == list(range(2, 2 + len(data) + len(data) // raw.CSV_BLANK_EVERY))
    blank = [i for i, r in enumerate(lines) if r.value == ",,,,,,,,"]
    assert blank == [100 + 101 * i for i in range(len(data) // raw.CSV_BLANK_EVERY)]
    texts = [r.value for i, r in enumerate(lines) if i not in blank]
    whole = [(t, r) for t, r in zip(texts, data, strict=True) if r.l_suppkey is not None and r.o_orderdate is not None]  # null cells are left out
    assert [t.split(",")[3] for t, _ in whole] == ["" if r.l_suppkey % 11 == 0 else f"st_{r.l_suppkey}" for _, r in whole]


@pytest.mark.parametrize("n, parts, most", [(0, 3, 10), (1, 4, 10), (95, 3, 10), (100, 1, 10), (40, 2, 1)])
def test_history_array_files(spark, tmp_path, n, parts, most):
    """every file is a JSON array of so many records at most, all records are there, and no text is shuffled for it."""
    lines = spark.range(0, n, 1, parts).select(F.format_string('{"batch_id":"B-%d","comment":"a, ]"}', "id").alias("value"))
    out = raw.build_history_array(lines, most)
    assert "Exchange" not in _plan(out)
    out.write.option("maxRecordsPerFile", most).text(f"{tmp_path}/a")
    arrays = [json.loads(open(p).read()) for p in glob.glob(f"{tmp_path}/a/*.txt") if os.path.getsize(p)]
    assert max(map(len, arrays), default=0) == min(most, -(-n // parts)) and sum(map(len, arrays)) == n
    assert _rows(files.read_history_array(spark, f"{tmp_path}/a")) == _rows(lines)


def test_history_array_of_all_lines(spark, odd):
    got = files.read_history_array(spark, raw.history_array_files(spark, odd))
    assert got.count() > 200 and _rows(got.select("value")) == _rows(raw.history_lines(spark, odd))


def test_ingest_looks_up_narrow_items(spark, odd):
    """ids that can collide come of a one-field parse, the items' shuffle holds one list of staff; a load's copies are
    columns on disk."""
    result = ingest.ingest_submissions(raw.submissions(spark, odd), td.indicators(spark, odd), raw.stored_entries(spark, odd),
                                       raw.stored_presence(spark, odd), batch_index=raw.stored_batch_index(spark, odd))
    plan = result.entries._jdf.queryExecution().optimizedPlan().toString()
    assert "individual_items" not in result._probe._jdf.queryExecution().optimizedPlan().toString()
    assert not any("owner#" in x and "staff#" in x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Join"))
    want = [_rows(getattr(result, x)) for x in ("entries", "presence", "audit", "rejects")]
    result.materialize()
    assert result._parsed.inputFiles() and result._new_entries.inputFiles()
    assert [_rows(getattr(result, x)) for x in ("entries", "presence", "audit", "rejects")] == want and want[0] and want[2]

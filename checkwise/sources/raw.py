"""Raw-shaped inputs derived by Spark from the driver's tables (FIXTURES §4).

These give the ingest and import paths real nested/loosely-typed input whose
size grows with the tables:

* ``submissions`` — one JSON payload per order (Team and Individual items,
  present staff, duplicates, falsy comments, bad dates).
* ``stored_entries`` / ``stored_presence`` — the part already in the store
  before the ingest runs (every tenth order).
* ``history_lines`` — one JSON Lines record per line item, with key aliases and
  dynamically typed check values.
* ``csv_lines`` — headered CSV text, one line per early line item, numbered in
  file order, with blank separator lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checkwise.operators.numbering import in_order, numbered
from checkwise.sources import store
from checkwise.sources import testdata as td

# Fixed values of the derivation (FIXTURES §4).
STORED_EVERY = 10          # orders with o_orderkey % 10 = 0 are already stored
BAD_DATE_EVERY = 97        # orders with o_orderkey % 97 = 0 carry date 'bad'
CSV_BLANK_EVERY = 100      # a ',,,,,,,,' line follows every 100th data row
CSV_DATE_SHIFT_DAYS = 10000
CSV_HEADER = "Date,Room,Slot,Staff ID,Type,KPI Indicator,Category,Result,Weight"


def _order_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = td.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = td.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = td.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = td.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "r_name"))


def _check_text(flag: Column, linenumber: Column) -> Column:
    return (F.when(flag == "R", "no").when(flag == "A", "yes")
            .when(linenumber % 2 == 1, "yes"))


def _comment_text(qty: Column) -> Column:
    q = qty.cast("long") % 3
    return F.when(q == 0, "").when(q == 1, "0").otherwise(" late ")


def _key(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    return store.input_key(spark, [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names])


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission log (seq, payload, submitted_by, ip), written once per
    input folder like a landed request log, then read back."""
    key = _key(spark, sf_dir, ["lineitem", "orders", "customer", "nation", "region", "part"])
    return store.materialize(spark, "submissions", key, lambda: build_submissions(spark, sf_dir))


def build_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One submission per order: (seq, payload, submitted_by, ip)."""
    li = td.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    ind = td.indicators(spark, sf_dir).select(F.col("id").alias("_iid"), F.col("scope").alias("iscope"))
    # an order's lines meet once, as narrow rows; all else is made of them there
    lines = li.join(ind, ind._iid == li.l_partkey + 1).repartition("l_orderkey")
    per_order = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(
        "iscope", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).alias("_lines"))

    def made(x: Column, dup: int) -> Column:
        check = _check_text(x["l_returnflag"], x["l_linenumber"])
        if dup:
            check = F.when(check == "yes", "no").otherwise("yes")
        return F.struct(
            x["iscope"].alias("iscope"),
            F.struct(F.lit(dup).alias("dup"), x["l_linenumber"].alias("l_linenumber"), x["l_partkey"].alias("l_partkey"),
                     x["l_suppkey"].alias("l_suppkey")).alias("pos"),
            F.struct((x["l_partkey"] + 1).cast("string").alias("indicator_id"), check.alias("check"),
                     _comment_text(x["l_quantity"]).alias("comment")).alias("item"),
            F.concat(F.lit("st_"), x["l_suppkey"].cast("string")).alias("owner"))

    # line 1 is sent a second time, at the end, with the opposite answer
    per_order = per_order.select("l_orderkey", F.concat(
        F.transform("_lines", lambda x: made(x, 0)),
        F.transform(F.filter("_lines", lambda x: x["l_linenumber"] == 1), lambda x: made(x, 1))).alias("_items"))

    def ordered(scope: str, with_owner: bool) -> Column:
        return F.sort_array(F.transform(F.filter("_items", lambda x: x["iscope"] == scope), lambda x: F.struct(
            x["pos"].alias("pos"), x["item"].alias("item"), *([x["owner"].alias("owner")] if with_owner else []))))

    present = F.filter(F.transform("_items", lambda x: x["owner"]), lambda x: x.isNotNull())
    per_order = per_order.select("l_orderkey", ordered("Team", False).alias("_team"), ordered("Individual", True).alias("_ind"),
                                 F.sort_array(F.array_distinct(present)).alias("_present"))
    owners = F.array_distinct(F.transform("_ind", lambda x: x["owner"]))
    ind_map = F.map_from_arrays(
        owners,
        F.transform(owners, lambda o: F.transform(F.filter("_ind", lambda x: x["owner"] == o),
                                                  lambda x: x["item"])))
    ctx = _order_context(spark, sf_dir)
    k = F.col("o_orderkey")
    date = (F.when(k % BAD_DATE_EVERY == 0, F.lit("bad"))
            .when(k % 2 == 0, F.date_format("o_orderdate", "MM-dd-yyyy"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    payload = F.to_json(F.struct(
        F.concat(F.lit("B-"), k.cast("string")).alias("batch_id"),
        date.alias("date"),
        F.col("r_name").alias("room_code"),
        F.col("o_orderpriority").alias("slot_code"),
        F.concat("_present", F.array(F.lit(""))).alias("present_staff_ids"),
        F.transform("_team", lambda x: x["item"]).alias("team_items"),
        ind_map.alias("individual_items")))
    return (per_order.join(ctx, per_order.l_orderkey == ctx.o_orderkey)
            .select(k.alias("seq"), payload.alias("payload"),
                    F.concat(F.lit("mgr_"), (F.col("o_custkey") % 5).cast("string")).alias("submitted_by"),
                    F.concat(F.lit("10.0.0."), (F.col("o_custkey") % 250).cast("string")).alias("ip")))


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries already in the store: every line of every tenth order, as in the fact table (a table of their own: the other
    nine tenths are numbered, but not joined, sorted and written)."""
    return td.stored_fact_table(spark, sf_dir, "stored_entries", lambda: td.entries_unmaterialised(spark, sf_dir, _stored_orders()))


def _stored_orders() -> Column:
    return F.col("l_orderkey") % STORED_EVERY == 0


def stored_batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, entry_month) of the stored entries — the small side table the
    sink maintains next to the fact table (built here once per input)."""
    key = _key(spark, sf_dir, ["lineitem", "orders", "customer", "nation", "region", "part"])
    return store.materialize(
        spark, "batch_index", key,
        lambda: td.entries_without_id(spark, sf_dir, _stored_orders()).select("batch_id", "entry_month").distinct())


def stored_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored presence table (kpi_batch_presence) of the stored entries,
    built once per input."""
    key = _key(spark, sf_dir, ["lineitem", "orders", "customer", "nation", "region", "part"])
    return store.materialize(
        spark, "stored_presence", key,
        lambda: td.entries_without_id(spark, sf_dir, _stored_orders()).select("batch_id", "staff_id").distinct())


def probe_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch ids a client would check: one per order."""
    o = td.table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("B-"), F.col("o_orderkey").cast("string")).alias("batch_id"))


def _lines_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = td.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    ind = td.indicators(spark, sf_dir).select(
        F.col("id").alias("_iid"), F.col("scope").alias("iscope"), "indicator_text", "category",
        F.col("weight").cast("int").alias("w"))
    ctx = _order_context(spark, sf_dir)
    # the wide text of the indicators last: it is shuffled with its lines once less
    return (li.join(ctx, li.l_orderkey == ctx.o_orderkey)
            .join(ind, ind._iid == li.l_partkey + 1))


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History export, one JSON Lines record per line item (column ``value``),
    written once per input folder and read back."""
    key = _key(spark, sf_dir, ["lineitem", "orders", "customer", "nation", "region", "part"])
    return store.materialize(spark, "history_lines", key, lambda: build_history_lines(spark, sf_dir))


def build_history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines_with_context(spark, sf_dir)
    o, ln, pk, sk = (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    d = F.col("o_orderdate")
    dtext = (F.when(o % 4 == 0, F.date_format(d, "MM/dd/yyyy"))
             .when(o % 4 == 1, F.date_format(d, "MM-dd-yyyy"))
             .when(o % 4 == 2, F.date_format(d, "yyyy-MM-dd"))
             .otherwise(F.lit("n/a")))
    staff = F.concat(F.lit("st_"), sk.cast("string"))
    flag = F.col("l_returnflag")
    check = F.parse_json(F.when(flag == "R", F.lit('"no"')).when(flag == "A", F.lit('"yes"'))
                         .when(pk % 3 == 0, F.lit("1")).when(pk % 3 == 1, F.lit('"1"'))
                         .otherwise(F.lit("true")))
    q = F.col("l_quantity").cast("long") % 3
    rec = F.struct(
        F.when((ln != 7) & (ln % 2 == 1), F.concat(F.lit("B-"), o.cast("string"))).alias("batch_id"),
        F.when((ln != 7) & (ln % 2 == 0), F.concat(F.lit("H-"), o.cast("string"))).alias("batchId"),
        F.when(pk % 2 == 0, dtext).alias("date"),
        F.when(pk % 2 == 1, dtext).alias("entry_date"),
        F.when(o % 2 == 0, F.col("r_name")).alias("room"),
        F.when(o % 2 == 1, F.col("r_name")).alias("room_code"),
        F.when(sk % 2 == 0, F.col("o_orderpriority")).alias("slot"),
        F.when(sk % 2 == 1, F.col("o_orderpriority")).alias("slot_code"),
        F.when(ln % 2 == 1, staff).alias("staff_id"),
        F.when(ln % 2 == 0, staff).alias("staffId"),
        F.when(pk % 13 == 0, F.lit(None).cast("string"))
         .when(pk % 97 == 0, F.lit("Group"))
         .when(pk % 89 == 0, F.lower("iscope"))
         .otherwise(F.col("iscope")).alias("scope"),
        F.when(pk % 5 != 0, F.col("indicator_text")).alias("indicator"),
        F.when(pk % 5 == 0, F.col("indicator_text")).alias("indicator_text"),
        F.when(pk % 7 != 0, F.col("category")).alias("category"),
        check.alias("check"),
        F.when(pk % 11 != 0, F.parse_json(F.col("w").cast("string"))).alias("weight"),
        F.when(q == 1, F.lit("0")).when(q == 2, F.lit(" late ")).alias("comment"))
    return x.select(F.to_json(rec).alias("value"))


def _csv_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV export's data lines (line_no, value); the header is record 1.
    Their texts are written once per input folder, in order, and numbered as they are read back."""
    key = _key(spark, sf_dir, ["lineitem", "orders", "customer", "nation", "region", "part"])
    return number_csv_lines(store.materialize(spark, "csv_lines", key, lambda: build_csv_lines(spark, sf_dir), spread=False))


def number_csv_lines(rows: DataFrame) -> DataFrame:
    """(line_no, value) of the rows that ``build_csv_lines`` put in order, and the blank lines between them."""
    k = F.col("k")
    line_no = 1 + k + F.floor((k - 1) / CSV_BLANK_EVERY).cast("long")
    line = F.struct(line_no.alias("line_no"), "value")
    blank = F.struct((line_no + 1).alias("line_no"), F.lit(",,,,,,,,").alias("value"))
    return numbered(rows, "k").select(F.inline(F.when(k % CSV_BLANK_EVERY == 0, F.array(line, blank)).otherwise(F.array(line))))


def build_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the data rows, sorted, with what numbers them (``operators/numbering``)."""
    x = _lines_with_context(spark, sf_dir)
    o, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    d = F.date_add(F.col("o_orderdate").cast("date"), CSV_DATE_SHIFT_DAYS)
    serial = F.datediff(d, F.lit("1899-12-30").cast("date"))
    dtext = (F.when(o % 5 == 0, F.date_format(d, "M/d/yyyy"))
             .when(o % 5 == 1, F.date_format(d, "MM-dd-yyyy"))
             .when(o % 5 == 2, F.date_format(d, "yyyy-MM-dd"))
             .when(o % 5 == 3, serial.cast("string"))
             .otherwise(F.lit("n/a")))
    flag = F.col("l_returnflag")
    cells = [dtext,
             F.when(pk % 17 == 0, F.lit("")).otherwise(F.col("r_name")),
             F.col("o_orderpriority"),
             F.when(sk % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("st_"), sk.cast("string"))),
             F.when(pk % 83 == 0, F.upper("iscope")).otherwise(F.col("iscope")),
             _csv_quote(F.col("indicator_text")),
             _csv_quote(F.col("category")),
             F.when(flag == "R", "No").when(flag == "A", "YES").otherwise(F.lit("")),
             F.when(pk % 79 == 0, F.lit("1500")).otherwise(
                 F.concat(F.col("w").cast("string"), F.when(pk % 3 == 0, F.lit(" pts")).otherwise(F.lit(""))))]
    data = x.select(*td.LINE_KEY, F.concat_ws(",", *cells).alias("value"))
    return in_order(data, list(td.LINE_KEY)).drop(*td.LINE_KEY)


#: Records in one CSV or JSON file of the exports below.
FILE_RECORDS = 100_000
BREAK_EVERY = 4            # every fourth CSV record has a line break and quotes in its indicator cell


def csv_files(spark: SparkSession, sf_dir: str) -> str:
    """The CSV export as files (folder=<n>/), each with a BOM, its own header and FILE_RECORDS records at most. Cells of
    every fourth record hold a line break and quotes."""
    key = _key(spark, sf_dir, ["lineitem", "orders", "customer", "nation", "region", "part"])
    return store.materialize_text(spark, "csv_files", key, lambda: build_csv_files(csv_lines(spark, sf_dir)))


def build_csv_files(lines: DataFrame) -> DataFrame:
    place = F.col("line_no") - 2
    row = (place % FILE_RECORDS + 2).alias("row")
    broken = F.regexp_replace("value", " Brand", '\n""Brand""')
    rows = lines.select(F.floor(place / FILE_RECORDS).cast("long").alias("folder"), row,
                        F.when(F.col("line_no") % BREAK_EVERY == 0, broken).otherwise(F.col("value")).alias("value"))
    header = rows.select("folder").distinct().select("folder", F.lit(1).cast("long").alias("row"),
                                                     F.lit("\ufeff" + CSV_HEADER).alias("value"))
    return rows.unionByName(header)


def history_array_files(spark: SparkSession, sf_dir: str) -> str:
    """The history export as the legacy system keeps it: files that hold one JSON array each, of FILE_RECORDS records at most."""
    key = _key(spark, sf_dir, ["lineitem", "orders", "customer", "nation", "region", "part"])
    return store.materialize_lines(spark, "history_array", key, lambda: build_history_array(build_history_lines(spark, sf_dir)), FILE_RECORDS)


def build_history_array(lines: DataFrame, records: int = FILE_RECORDS) -> DataFrame:
    """The lines of the files: each task closes an array every so many records and behind its last one, so the texts are
    neither sorted nor shuffled for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = 0, None  # the last record waits: it closes the array if none follows
        for batch in batches:
            for lo in range(0, len(batch), records):
                values = batch.column(0).slice(lo, records)
                values = pa.concat_arrays([last, values]) if last is not None else values
                if len(values) > 1:
                    yield marked(values.slice(0, len(values) - 1), place, False)
                place, last = place + len(values) - 1, values.slice(len(values) - 1)
        if last is not None:
            yield marked(last, place, True)

    def marked(values: pa.Array, place: int, end: bool) -> pa.RecordBatch:
        at = (place + np.arange(len(values))) % records
        before = pc.if_else(pa.array(at == 0), "[", ",")
        behind = pc.if_else(pa.array((at == records - 1) | end), "]", "")
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(before, values, behind, "")], ["value"])

    return lines.select("value").mapInArrow(run, "value string")


def staff_load_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staff load: every supplier, each sent twice (the first wins),
    some of them already stored (the stored row wins). Column ``seq`` orders."""
    s = td.table(spark, sf_dir, "supplier")
    sid = F.concat(F.lit("st_"), F.col("s_suppkey").cast("string"))

    def version(prefix: str, dup: int) -> DataFrame:
        return s.select(sid.alias("staff_id"), F.concat(F.lit(prefix), F.col("s_name")).alias("staff_name"),
                        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("rooms"),
                        F.lit(1).alias("active"), (F.col("s_suppkey") * 2 + dup).alias("seq"))
    return version("NEW ", 0).unionByName(version("DUP ", 1))


def entries_with_mixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table with room codes written three ways (as is, lower case,
    with trailing spaces) — equal under a case/space-insensitive collation."""
    e = td.kpi_entries(spark, sf_dir)
    v = F.col("id") % 3
    return e.withColumn("room_code", F.when(v == 1, F.lower("room_code"))
                        .when(v == 2, F.concat(F.col("room_code"), F.lit("  ")))
                        .otherwise(F.col("room_code")))

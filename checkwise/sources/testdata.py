"""Canonical tables derived from the driver's TPC-H-ish parquet.

The mapping (FIXTURES.md §3) turns the star schema into the checklist model:
regions are rooms, suppliers are staff, order priorities are time slots, parts
are indicators and line items are scored entries. Dimensions stay lazy (they
are small and Catalyst prunes them); the fact table is materialised once per
input folder, partitioned by month and sorted by (room_code, entry_date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checkwise.functions.scoring import earned_points
from checkwise.operators.numbering import with_row_number
from checkwise.schemas import (INDICATORS, KPI_ENTRIES_STORED, POINTS, ROOMS, SLOTS,
                               STAFF, WEIGHT)
from checkwise.sources import store

# Fixed values of the mapping: the slot each part number points at, by
# p_partkey % 5, and the region that is not a room.
SLOT_BY_PART_MOD5 = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NOT_A_ROOM_REGION = 2
ADMIN_REGION = 4
INACTIVE_REGION = 3
INACTIVE_SLOT = "4-NOT SPECIFIED"
# (l_orderkey, l_linenumber) alone repeats in the test data; this does not.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _stored_dim(spark: SparkSession, sf_dir: str, name: str, inputs: list[str], build, schema):
    """Dimensions are stored tables: derived once per input folder, then read."""
    key = store.input_key(spark, [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in inputs])
    # written in the input's own partitioning: a small dimension stays one file
    return store.materialize(spark, f"dim_{name}", key, build, schema=schema, spread=False)


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_dim(spark, sf_dir, "rooms", ["region"], lambda: derive_rooms(spark, sf_dir), ROOMS)


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_dim(spark, sf_dir, "staff", ["supplier", "nation", "region"],
                       lambda: derive_staff(spark, sf_dir), STAFF)


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_dim(spark, sf_dir, "slots", ["orders"], lambda: derive_slots(spark, sf_dir), SLOTS)


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_dim(spark, sf_dir, "indicators", ["part", "region"],
                       lambda: derive_indicators(spark, sf_dir), INDICATORS)


def derive_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return (r.where(F.col("r_regionkey") != NOT_A_ROOM_REGION)
            .select(F.col("r_name").alias("room_code"),
                    F.concat(F.col("r_name"), F.lit(" Room")).alias("room_name"),
                    (F.col("r_regionkey") == ADMIN_REGION).cast("int").alias("is_admin"),
                    (F.col("r_regionkey") != INACTIVE_REGION).cast("int").alias("active")))


def derive_staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("s_suppkey")
    return (s.where(k % 13 != 0)
            .join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(F.concat(F.lit("st_"), k.cast("string")).alias("staff_id"),
                    F.col("s_name").alias("staff_name"),
                    F.when(k % 3 == 0, F.lit("Teacher")).alias("role"),
                    F.when(k % 7 == 0, F.lit(None).cast("string"))
                     .when(k % 2 == 0, F.col("r_name"))
                     .otherwise(F.concat(F.col("r_name"), F.lit(", ASIA"))).alias("rooms"),
                    (F.col("s_acctbal") >= 0).cast("int").alias("active")))


def derive_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return (table(spark, sf_dir, "orders").select(p).distinct()
            .select(p.alias("slot_code"),
                    F.concat(F.lit("Slot "), p).alias("slot_label"),
                    F.substring(p, 1, 1).alias("slot_short"),
                    F.substring(p, 1, 1).cast("int").alias("sort_order"),
                    (p != INACTIVE_SLOT).cast("int").alias("active")))


def derive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    r = table(spark, sf_dir, "region")
    k = F.col("p_partkey")
    slot_names = F.array(*[F.lit(s) for s in SLOT_BY_PART_MOD5])
    return (p.join(r, r.r_regionkey == (k % 5), "left")
            .select((k + 1).cast("long").alias("id"),
                    F.when(k % 4 == 0, F.lit("*")).otherwise(F.col("r_name")).alias("room_code"),
                    F.when(k % 3 == 0, F.lit("*"))
                     .otherwise(F.element_at(slot_names, (k % 5 + 1).cast("int"))).alias("slot_code"),
                    F.when(F.col("p_size") % 5 == 0, F.lit("Individual"))
                     .otherwise(F.lit("Team")).alias("scope"),
                    F.col("p_type").alias("category"),
                    F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("indicator_text"),
                    (F.col("p_size") % 7 + 1).cast(WEIGHT).alias("weight"),
                    F.col("p_size").cast("int").alias("sort_order"),
                    (k % 50 != 0).cast("int").alias("active")))


def entries_unmaterialised(spark: SparkSession, sf_dir: str, of_orders: Column | None = None) -> DataFrame:
    """The fact rows as a plan over the input tables (one row per line item). ``of_orders``: a test of ``l_orderkey``, only
    the rows of these orders; their ids are those among all rows."""
    # surrogate id: 1..N over the full line key, numbered without a global window
    li = with_row_number(_lines(spark, sf_dir), list(LINE_KEY), "_id")
    return _entries(spark, sf_dir, li if of_orders is None else li.where(of_orders))


def entries_without_id(spark: SparkSession, sf_dir: str, of_orders: Column) -> DataFrame:
    """The fact rows of the orders that pass the test of ``l_orderkey``, without their ids: nothing is sorted or written."""
    li = _lines(spark, sf_dir).where(of_orders)
    return _entries(spark, sf_dir, li.withColumn("_id", F.lit(None).cast("long"))).drop("id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")


def _entries(spark: SparkSession, sf_dir: str, li: DataFrame) -> DataFrame:
    """The entries of numbered lines (``_id``)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    ind = derive_indicators(spark, sf_dir).select(
        F.col("id").alias("indicator_id"), "scope", "indicator_text", "category", "weight")
    check = F.when(F.col("l_returnflag") == "R", 0).otherwise(1)
    # customers join the orders before the lines do, which are shuffled once less
    ctx = (o.join(c, o.o_custkey == c.c_custkey)
           .join(n, c.c_nationkey == n.n_nationkey)
           .join(r, n.n_regionkey == r.r_regionkey))
    return (li.join(ctx, li.l_orderkey == ctx.o_orderkey)
            .join(ind, ind.indicator_id == li.l_partkey + 1)
            .select(F.col("_id").cast("long").alias("id"),
                    F.concat(F.lit("B-"), F.col("l_orderkey").cast("string")).alias("batch_id"),
                    F.col("o_orderdate").cast("date").alias("entry_date"),
                    F.col("r_name").alias("room_code"),
                    F.col("o_orderpriority").alias("slot_code"),
                    F.concat(F.lit("st_"), F.col("l_suppkey").cast("string")).alias("staff_id"),
                    "scope", "indicator_id", "indicator_text", "category",
                    check.alias("check_value"),
                    "weight",
                    earned_points(check, F.col("weight")).alias("earned_points"),
                    F.col("weight").cast(POINTS).alias("possible_points"),
                    F.when(F.col("l_returnflag") == "R", F.lit("late")).alias("comment"),
                    F.concat(F.lit("clerk_"), (F.col("o_custkey") % 10).cast("string")).alias("submitted_by"),
                    F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
            .withColumn("entry_month", F.trunc("entry_date", "month")))


def kpi_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored fact table: built once per input folder, then read back.

    Stored layout: ``entry_month=YYYY-MM-01/`` folders, rows sorted by
    (room_code, entry_date) inside, so date ranges prune folders and room/date
    predicates skip row groups."""
    return stored_fact_table(spark, sf_dir, "kpi_entries", lambda: entries_unmaterialised(spark, sf_dir))


def stored_fact_table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    names = ["lineitem", "orders", "customer", "nation", "region", "part"]
    key = store.input_key(spark, [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names])
    return store.materialize(
        spark, name, key, build,
        # id makes the range order total, so a hot (month, room, day) still
        # splits across write tasks
        partition_by=["entry_month"], sort_within=["room_code", "entry_date", "id"],
        schema=KPI_ENTRIES_STORED)


"""Fixed schemas of the canonical tables and of the raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T

POINTS = T.DecimalType(8, 2)
WEIGHT = T.DecimalType(5, 2)

# Fixed values of the data model: the two scopes, in their enum order
# (Team sorts before Individual), and the column length limits of the tables.
SCOPES = ("Team", "Individual")
LIMITS = {
    "code": 32,          # room_code, slot_code
    "id": 64,            # staff_id, batch_id, submitted_by, user, action
    "name": 128,         # room_name, staff_name, category
    "rooms_list": 256,   # staff.rooms
    "text": 512,         # indicator_text
}
MAX_WEIGHT = 999.99      # DECIMAL(5,2)

ROOMS = T.StructType([
    T.StructField("room_code", T.StringType(), False),
    T.StructField("room_name", T.StringType(), False),
    T.StructField("is_admin", T.IntegerType(), False),
    T.StructField("active", T.IntegerType(), False),
])

SLOTS = T.StructType([
    T.StructField("slot_code", T.StringType(), False),
    T.StructField("slot_label", T.StringType(), False),
    T.StructField("slot_short", T.StringType(), True),
    T.StructField("sort_order", T.IntegerType(), False),
    T.StructField("active", T.IntegerType(), False),
])

STAFF = T.StructType([
    T.StructField("staff_id", T.StringType(), False),
    T.StructField("staff_name", T.StringType(), False),
    T.StructField("role", T.StringType(), True),
    T.StructField("rooms", T.StringType(), True),
    T.StructField("active", T.IntegerType(), False),
])

INDICATORS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("room_code", T.StringType(), False),
    T.StructField("slot_code", T.StringType(), False),
    T.StructField("scope", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("indicator_text", T.StringType(), False),
    T.StructField("weight", WEIGHT, False),
    T.StructField("sort_order", T.IntegerType(), False),
    T.StructField("active", T.IntegerType(), False),
])

PRESENCE = T.StructType([
    T.StructField("batch_id", T.StringType(), False),
    T.StructField("staff_id", T.StringType(), False),
])

# Columns an ingest or import writes (the table adds id and created_at).
ENTRY_COLUMNS = [
    "batch_id", "entry_date", "room_code", "slot_code", "staff_id", "scope",
    "indicator_id", "indicator_text", "category", "check_value", "weight",
    "earned_points", "possible_points", "comment", "submitted_by",
]

KPI_ENTRIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("batch_id", T.StringType(), False),
    T.StructField("entry_date", T.DateType(), False),
    T.StructField("room_code", T.StringType(), False),
    T.StructField("slot_code", T.StringType(), False),
    T.StructField("staff_id", T.StringType(), False),
    T.StructField("scope", T.StringType(), False),
    T.StructField("indicator_id", T.LongType(), True),
    T.StructField("indicator_text", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("check_value", T.IntegerType(), False),
    T.StructField("weight", WEIGHT, False),
    T.StructField("earned_points", POINTS, False),
    T.StructField("possible_points", POINTS, False),
    T.StructField("comment", T.StringType(), True),
    T.StructField("submitted_by", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

# Stored layout: the fact table is partitioned by month.
KPI_ENTRIES_STORED = T.StructType(KPI_ENTRIES.fields + [
    T.StructField("entry_month", T.DateType(), True),
])

AUDIT = T.StructType([
    T.StructField("user", T.StringType(), True),
    T.StructField("action", T.StringType(), False),
    T.StructField("batch_id", T.StringType(), True),
    T.StructField("ip", T.StringType(), True),
    T.StructField("rows_saved", T.LongType(), True),
    T.StructField("note", T.StringType(), True),
])

# --- raw inputs -------------------------------------------------------------

# indicator_id is read as text and converted with a loose integer cast, so
# 5, "5" and 5.0 all name indicator 5.
ITEM = T.StructType([
    T.StructField("indicator_id", T.StringType(), True),
    T.StructField("check", T.StringType(), True),
    T.StructField("comment", T.StringType(), True),
])

SUBMISSION = T.StructType([
    T.StructField("batch_id", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("room_code", T.StringType(), True),
    T.StructField("slot_code", T.StringType(), True),
    T.StructField("present_staff_ids", T.ArrayType(T.StringType()), True),
    T.StructField("team_items", T.ArrayType(ITEM), True),
    T.StructField("individual_items", T.MapType(T.StringType(), T.ArrayType(ITEM)), True),
    # holds the raw text when the payload is not valid JSON
    T.StructField("_corrupt", T.StringType(), True),
])

# History record keys, in the order the import looks them up.
HISTORY_STRING_KEYS = [
    "batch_id", "batchId", "date", "entry_date", "room", "room_code", "slot",
    "slot_code", "staff_id", "staffId", "scope", "indicator", "indicator_text",
    "category", "comment",
]
HISTORY_VARIANT_KEYS = ["check", "check_value", "weight"]

"""Reference data reads: active dimensions (R5), applicable checklist (C1),
staff of a room (C2). Dimension ``active`` flags apply here and in the ingest
lookup only; reports show inactive staff and rooms on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkwise.functions.scoring import scope_order


def active_rooms(rooms: DataFrame) -> DataFrame:
    return (rooms.where(F.col("active") == 1)
            .select("room_code", "room_name", F.col("is_admin").cast("int").alias("is_admin"))
            .orderBy("room_code"))


def active_slots(slots: DataFrame) -> DataFrame:
    return (slots.where(F.col("active") == 1)
            .select("slot_code", "slot_label", "slot_short", F.col("sort_order").cast("int").alias("sort_order"))
            .orderBy("sort_order"))


def active_staff(staff: DataFrame) -> DataFrame:
    return (staff.where(F.col("active") == 1)
            .select("staff_id", "staff_name", "role", "rooms")
            .orderBy(F.col("staff_name").asc_nulls_first(), "staff_id"))


def active_indicators(indicators: DataFrame) -> DataFrame:
    """Active indicators in display order: scope (enum order), sort_order, id.
    Weight is handed out as a float, like the config endpoint does."""
    return (indicators.where(F.col("active") == 1)
            .select("id", "room_code", "slot_code", "scope", "category", "indicator_text",
                    F.col("weight").cast("double").alias("weight"),
                    F.col("sort_order").cast("int").alias("sort_order"))
            .orderBy(scope_order(F.col("scope")), "sort_order", "id"))


def wildcard_match(code_col, value) -> "F.Column":
    """``code = value OR code = '*'``."""
    return (code_col == value) | (code_col == F.lit("*"))


def checklist(indicators: DataFrame, room: str, slot: str, scope: str) -> DataFrame:
    """C1. Active indicators of one scope that apply to (room, slot); '*' in an
    indicator's room or slot means "any". A filter over the dimension."""
    ind = active_indicators(indicators)
    return ind.where((F.col("scope") == scope)
                     & wildcard_match(F.col("room_code"), room)
                     & wildcard_match(F.col("slot_code"), slot))


def room_list(rooms_csv) -> "F.Column":
    """'A, B' -> ['A', 'B'] (split at commas, each part trimmed)."""
    return F.transform(F.split(rooms_csv, ","), lambda x: F.trim(x))


def staff_by_room(staff: DataFrame, room: str) -> DataFrame:
    """C2. Active staff whose room list contains ``room`` or who have no list."""
    s = active_staff(staff)
    rooms = F.col("rooms")
    unrestricted = rooms.isNull() | (rooms == "")
    return s.where(unrestricted | F.array_contains(room_list(rooms), room))


def checklists(contexts: DataFrame, indicators: DataFrame) -> DataFrame:
    """C1 for many (room, slot) contexts at once: every active indicator that
    applies to each context, through exploded wildcard keys (equi-join)."""
    from checkwise.operators.lookup import applicable

    ctx = contexts.select("room_code", "slot_code").distinct()
    hits = applicable(ctx, indicators)
    ind = indicators.select(F.col("id").alias("indicator_id"), "scope", "category", "indicator_text",
                            F.col("weight").cast("double").alias("weight"),
                            F.col("sort_order").cast("int").alias("sort_order"))
    return (hits.join(ind, "indicator_id")
            .orderBy("room_code", "slot_code", scope_order(F.col("scope")), "sort_order", "indicator_id"))

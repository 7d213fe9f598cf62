"""C3 checklist completeness: how many applicable Team indicators each batch
left unanswered (0 = complete).

One pass over the entries: a left join to the active Team indicators on the
indicator id with the wildcard room/slot test as residual (hash join), then one
aggregation per batch counting the distinct answered indicators. The expected
count of a batch is the sum of the indicator counts of its (room, slot), its
two half-wildcard forms and ('*', '*'): four joins to a table of counts, which
is broadcast after a check of its bytes, so no row moves by (room, slot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkwise.operators.lookup import ANY, active_snapshot
from checkwise.operators.sizing import MAX_BYTES, broadcast_if_small, byte_size


def checklist_completeness(entries: DataFrame, indicators: DataFrame) -> DataFrame:
    team = active_snapshot(indicators, "Team").select(
        F.col("id").alias("_iid"), F.col("room_code").alias("_iroom"), F.col("slot_code").alias("_islot"))
    e = entries.select("batch_id", "room_code", "slot_code",
                       F.when(F.col("scope") == "Team", F.col("indicator_id")).alias("_tid"))
    t = broadcast_if_small(team)
    cond = ((e["_tid"] == t["_iid"])
            & ((t["_iroom"] == e["room_code"]) | (t["_iroom"] == "*"))
            & ((t["_islot"] == e["slot_code"]) | (t["_islot"] == "*")))
    per_batch = (e.join(t, cond, "left")
                 .groupBy("batch_id", "room_code", "slot_code")
                 .agg(F.countDistinct("_iid").alias("answered_items")))
    # indicators per (room, slot) as written, wildcards included: a table no larger than the indicators
    counts = team.groupBy("_iroom", "_islot").agg(F.count(F.lit(1)).alias("_n"))
    small = byte_size(team) <= MAX_BYTES
    any_room, any_slot = F.lit(ANY), F.lit(ANY)
    room_named, slot_named = ~F.col("room_code").eqNullSafe(any_room), ~F.col("slot_code").eqNullSafe(any_slot)
    forms = [(F.col("room_code"), F.col("slot_code"), F.lit(True)), (F.col("room_code"), any_slot, slot_named),
             (any_room, F.col("slot_code"), room_named), (any_room, any_slot, room_named & slot_named)]
    out = per_batch
    for i, (room, slot, holds) in enumerate(forms):
        form = counts.select(F.col("_iroom").alias(f"_room{i}"), F.col("_islot").alias(f"_slot{i}"),
                             F.col("_n").alias(f"_n{i}"))
        out = out.join(F.broadcast(form) if small else form,
                       (F.when(holds, room) == F.col(f"_room{i}")) & (F.when(holds, slot) == F.col(f"_slot{i}")), "left")
    expected = sum((F.coalesce(F.col(f"_n{i}"), F.lit(0).cast("long")) for i in range(1, len(forms))),
                   F.coalesce(F.col("_n0"), F.lit(0).cast("long")))
    return (out.select("batch_id", "room_code", "slot_code", expected.alias("expected_items"), "answered_items")
            .withColumn("unanswered_items", F.col("expected_items") - F.col("answered_items")))

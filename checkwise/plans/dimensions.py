"""I5 dimension loads with insert-ignore semantics.

Keyed dimensions (rooms, slots, staff) keep the first row per primary key —
first within the load (by ``order``), and stored rows always win over new
ones. Indicators have no natural key: a re-load appends them again, exactly
like the reference's seed. Returns the resulting table and the number of rows
the load added (for the audit row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkwise.operators.dedup import first_wins, insert_ignore

PRIMARY_KEYS = {"rooms": ["room_code"], "slots": ["slot_code"], "staff": ["staff_id"]}
# Fixed value: the audit action of a dimension load.
SEED_ACTION = "seed_config"


def load_dimension(existing: DataFrame, new_rows: DataFrame, keys: list[str] | None,
                   order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    cols = existing.columns
    if not keys:
        added = new_rows.select(*cols)
    else:
        firsts = first_wins(new_rows, keys, order or [F.monotonically_increasing_id()])
        added = insert_ignore(firsts.select(*cols), existing, keys)
    return existing.unionByName(added), added


def audit_row(loaded: list[DataFrame], action: str = SEED_ACTION) -> DataFrame:
    """One audit row for a dimension load; like the reference, it counts the
    rows *offered* to all tables (not only the ones a first-wins load kept)."""
    counts = [df.select(F.lit(1).alias("one")) for df in loaded]
    allrows = counts[0]
    for c in counts[1:]:
        allrows = allrows.unionByName(c)
    return allrows.agg(F.count(F.lit(1)).alias("rows_saved")).select(
        F.lit("anonymous").alias("user"), F.lit(action).alias("action"), F.lit("").alias("batch_id"),
        F.lit("").alias("ip"), "rows_saved", F.lit(None).cast("string").alias("note"))

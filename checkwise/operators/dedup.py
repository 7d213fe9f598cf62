"""Unique-key semantics of the fact table.

The unique key (batch_id, staff_id, indicator_id) contains a nullable column,
and NULLs never collide in a unique index: rows with a NULL key part are never
duplicates of anything (imports write NULL ids, so re-running an import
doubles its rows). ``dropDuplicates`` would merge NULL keys, so both operators
here let NULL-key rows bypass the check (without splitting the input).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ENTRY_KEY = ["batch_id", "staff_id", "indicator_id"]


def _key_not_null(keys: list[str]) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & F.col(k).isNotNull()
    return c


def first_wins(rows: DataFrame, keys: list[str], order: list[Column],
               keys_never_null: bool = False) -> DataFrame:
    """Keep, per non-NULL key, the row that comes first in ``order``; rows with
    a NULL key part all survive.

    Planned as hash exchange on the key + sort + ``row_number() == 1``. When
    the caller guarantees non-NULL keys the filter is the plain rank limit, and
    Spark adds a partial per-key limit *before* the exchange (window group
    limit), dropping duplicates map-side. Otherwise NULL-key rows are kept by
    the filter itself, so the input is still read once (no union split)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(w))
    keep = F.col("_rn") == 1
    if not keys_never_null:
        keep = keep | ~_key_not_null(keys)
    return ranked.where(keep).drop("_rn")


def insert_ignore(new_rows: DataFrame, existing: DataFrame, keys: list[str],
                  probe: DataFrame | None = None) -> DataFrame:
    """Rows of ``new_rows`` whose key is not already in ``existing``.
    ``new_rows`` must already be unique per key. NULL-key rows are kept: an
    equality anti-join never matches a NULL, which is exactly the rule.

    ``probe`` (optional) holds the distinct values of one key column that the
    new rows can have (e.g. the batch ids of the accepted submissions). The
    stored table is semi-joined with it first, so only stored rows that can
    collide take part in the anti-join shuffle. The probe is the output of a
    shuffle (distinct), so adaptive execution sees its real size and
    broadcasts it only when it is under the broadcast threshold; otherwise the
    semi-join stays a shuffle join."""
    ex = existing.select(*keys).where(_key_not_null(keys))
    if probe is not None:
        col = probe.columns[0]
        ex = ex.join(probe, col, "left_semi")
    return new_rows.join(ex, keys, "left_anti")

"""Parse a text column once per row.

``from_json``/``from_csv`` results referenced by many later expressions can be
inlined into each reference by the optimizer (one parse per *field* instead of
per row). Expanding the parsed struct through a generator (``inline`` of a
one-element array) gives a plan boundary: the text is parsed exactly once and
the fields become plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_once(df: DataFrame, parsed: Column, keep: list[str | Column]) -> DataFrame:
    """``keep`` columns plus every field of the struct ``parsed`` as columns."""
    return df.select(*keep, F.inline(F.array(parsed)))


def parse_json_columns(df: DataFrame, text_col: str, schema: str, keep: list[str | Column]) -> DataFrame:
    return expand_once(df, F.from_json(F.col(text_col), schema), keep)


def parse_csv_columns(df: DataFrame, text_col: str, schema: str, keep: list[str | Column]) -> DataFrame:
    return expand_once(df, F.from_csv(F.col(text_col), schema, {"mode": "PERMISSIVE", "escape": '"'}), keep)


def freeze_columns(df: DataFrame) -> DataFrame:
    """Evaluate every column of ``df`` once per row. Later projections that use
    a computed column several times then read the value instead of having the
    optimizer inline (and recompute) its expression at each use."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))

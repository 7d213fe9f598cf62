"""Reports over the fact table: summary (paged), violations, daily, monthly, bands.

Shape of the shared core: filter (date range, optional room) -> one hash
aggregation on (staff_id, room_code) with four conditional sums, partial
aggregation map-side -> join the two dimensions to the *aggregated* rows (the
keys are the group keys and the dimension keys are unique, so this equals the
join-then-group of the original and the joins see only one row per group) ->
percentage columns -> sort / page.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkwise.functions.dates import parse_report_date
from checkwise.functions.scoring import (as_percent, hundredths, kpi_band, percent_hundredths,
                                         scope_order, total_hundredths)

# Paging and top-k bounds.
PAGE_DEFAULT = 50
PAGE_MAX = 200
VIOLATIONS_DEFAULT = 20
VIOLATIONS_MAX = 100

SUMMARY_COLUMNS = ["staff_id", "staff_name", "room_code", "is_admin",
                   "team_kpi", "ind_kpi", "total_kpi"]


def clamp_page(page, per_page) -> tuple[int, int]:
    """page = max(1, int(page)); per_page clamped to 1..200, default 50."""
    p = max(1, _int_or(page, 1))
    n = min(PAGE_MAX, max(1, _int_or(per_page, PAGE_DEFAULT)))
    return p, n


def clamp_limit(limit) -> int:
    return min(VIOLATIONS_MAX, max(1, _int_or(limit, VIOLATIONS_DEFAULT)))


_LEADING_INT = re.compile(r"^[ \t\n\r\x0b\f]*([+-]?[0-9]+)")
_TRIM = " \t\n\r\x00\x0b"


def _int_or(v, default: int) -> int:
    """Loose integer cast of a request parameter: '2abc' -> 2, 'x' -> 0,
    2.9 -> 2; missing -> ``default``."""
    if v is None:
        return default
    if isinstance(v, (int, float)):
        return int(v)
    m = _LEADING_INT.match(str(v))
    return int(m.group(1)) if m else 0


def _room_param(room) -> str | None:
    r = str(room or "").strip(_TRIM)
    return r or None


def _date_window(entries: DataFrame, date_from: dt.date, date_to: dt.date) -> DataFrame:
    """Inclusive date range. When the table is stored by month, the same range
    is also stated on the partition column so whole folders are pruned."""
    e = entries.where(F.col("entry_date").between(F.lit(date_from), F.lit(date_to)))
    if "entry_month" in entries.columns:
        e = e.where(F.col("entry_month").between(
            F.lit(date_from.replace(day=1)), F.lit(date_to.replace(day=1))))
    return e


def _day(entries: DataFrame, day: dt.date) -> DataFrame:
    e = entries.where(F.col("entry_date") == F.lit(day))
    if "entry_month" in entries.columns:
        e = e.where(F.col("entry_month") == F.lit(day.replace(day=1)))
    return e


def _collated(df: DataFrame, cols: list[str], collation: str | None) -> DataFrame:
    if collation is None:
        return df
    for c in cols:
        df = df.withColumn(c, F.collate(F.col(c), collation))
    return df


#: Sums of points, in hundredths.
POINTS = ["team_earned", "team_possible", "ind_earned", "ind_possible"]


def point_sums() -> list[Column]:
    """The aggregates of POINTS over entries."""
    def pts(scope: str, col: str) -> Column:
        return F.sum(F.when(F.col("scope") == scope, hundredths(F.col(col)))
                     .otherwise(F.lit(0).cast("long")))

    return [pts("Team", "earned_points").alias("team_earned"),
            pts("Team", "possible_points").alias("team_possible"),
            pts("Individual", "earned_points").alias("ind_earned"),
            pts("Individual", "possible_points").alias("ind_possible")]


def in_range(rows: DataFrame, date_from, date_to, room=None, key_collation: str | None = None) -> DataFrame:
    """Rows (entries or their roll-up) of an inclusive date range and, if given, of one room."""
    e = _date_window(rows, parse_report_date(date_from), parse_report_date(date_to))
    r = _room_param(room)
    if r is not None:
        room_col = F.collate(F.col("room_code"), key_collation) if key_collation else F.col("room_code")
        e = e.where(room_col == r)
    return e


def points_by_staff_room(entries: DataFrame, date_from, date_to, room=None,
                         with_batches: bool = False, key_collation: str | None = None) -> DataFrame:
    """Team/Individual earned and possible points (hundredths) per (staff, room).

    ``key_collation`` (e.g. ``UNICODE_CI_AI_RTRIM``) compares and groups the
    keys case-, accent- and trailing-space-insensitively like the reference's
    store. Grouping on collated strings is sort-based in Spark, so the rows are
    first pre-aggregated by a hash aggregate on the exact (binary) keys; only
    those partial sums — one row per distinct spelling — are re-grouped under
    the collation."""
    e = in_range(entries, date_from, date_to, room, key_collation)
    sums = point_sums()
    if key_collation is None:
        aggs = sums + ([F.countDistinct("batch_id").alias("total_batches")] if with_batches else [])
        return e.groupBy("staff_id", "room_code").agg(*aggs)
    keys = ["staff_id", "room_code"] + (["batch_id"] if with_batches else [])
    partial = e.groupBy(*keys).agg(*sums)
    resum = [F.sum(c).alias(c) for c in POINTS]
    if with_batches:
        resum.append(F.countDistinct(F.collate(F.col("batch_id"), key_collation)).alias("total_batches"))
    return (_collated(partial, ["staff_id", "room_code"], key_collation)
            .groupBy("staff_id", "room_code").agg(*resum))


def with_kpi(points: DataFrame, staff: DataFrame, rooms: DataFrame,
             key_collation: str | None = None) -> DataFrame:
    """Attach names/admin flag and turn points into the three percentages."""
    st = _collated(staff.select("staff_id", "staff_name"), ["staff_id"], key_collation)
    rm = _collated(rooms.select("room_code", "is_admin"), ["room_code"], key_collation)
    j = points.join(st, "staff_id", "left").join(rm, "room_code", "left")
    team = percent_hundredths(F.col("team_earned"), F.col("team_possible"))
    ind = percent_hundredths(F.col("ind_earned"), F.col("ind_possible"))
    j = j.withColumn("_team", team).withColumn("_ind", ind)
    total = total_hundredths(F.col("_team"), F.col("_ind"), F.col("is_admin"), F.col("ind_possible"))
    return (j.withColumn("team_kpi", as_percent(F.col("_team")))
            .withColumn("ind_kpi", as_percent(F.col("_ind")))
            .withColumn("total_kpi", as_percent(total)))


def _summary_order() -> list[Column]:
    # room, then name (NULLs first); staff_id makes the order total
    return [F.col("room_code").asc_nulls_first(), F.col("staff_name").asc_nulls_first(),
            F.col("staff_id").asc_nulls_first()]


def kpi_summary(entries: DataFrame, staff: DataFrame, rooms: DataFrame, date_from, date_to,
                room=None, page=None, per_page=None, key_collation: str | None = None) -> DataFrame:
    """R1. KPI per (staff, room) for an inclusive date range.

    With ``page``/``per_page`` the result is one page (clamped like the API);
    without them the whole ordered result is returned. With ``key_collation``
    the output keys are normalised (lower case, trailing spaces removed)."""
    k = with_kpi(points_by_staff_room(entries, date_from, date_to, room, key_collation=key_collation),
                 staff, rooms, key_collation)
    if key_collation is not None:
        for c in ("staff_id", "room_code"):
            k = k.withColumn(c, F.collate(F.lower(F.rtrim(F.col(c))), "UTF8_BINARY"))
    return summary_of(k, page, per_page)


def summary_of(k: DataFrame, page=None, per_page=None) -> DataFrame:
    """The ordered summary, or one clamped page of it, of rows with their percentages."""
    out = k.orderBy(*_summary_order()).select(*SUMMARY_COLUMNS)
    if page is None and per_page is None:
        return out
    p, n = clamp_page(page, per_page)
    return out.offset((p - 1) * n).limit(n)


def has_next_page(entries: DataFrame, staff: DataFrame, rooms: DataFrame, date_from, date_to,
                  room=None, page=None, per_page=None) -> bool:
    """L5: the dashboard offers a next page exactly when the current page is
    full. Counts one clamped page (at most 200 rows)."""
    p, n = clamp_page(page, per_page)
    return kpi_summary(entries, staff, rooms, date_from, date_to, room=room,
                       page=p, per_page=n).count() == n


def kpi_monthly(entries: DataFrame, staff: DataFrame, rooms: DataFrame, year, month,
                room=None, key_collation: str | None = None) -> DataFrame:
    """R4. Summary columns for one calendar month plus distinct batch count."""
    y, m = _int_or(year, 0), _int_or(month, 0)
    if not y:
        raise ValueError("Missing year")
    if not m:
        raise ValueError("Missing month")
    if not 1 <= m <= 12:
        raise ValueError(f"Invalid month: {m}")
    d0 = dt.date(y, m, 1)
    d1 = dt.date(y, m, calendar.monthrange(y, m)[1])
    k = with_kpi(points_by_staff_room(entries, d0, d1, room, with_batches=True,
                                      key_collation=key_collation), staff, rooms, key_collation)
    if key_collation is not None:
        for c in ("staff_id", "room_code"):
            k = k.withColumn(c, F.collate(F.lower(F.rtrim(F.col(c))), "UTF8_BINARY"))
    cols = SUMMARY_COLUMNS[:4] + ["total_batches"] + SUMMARY_COLUMNS[4:]
    return k.orderBy(*_summary_order()).select(*cols)


def top_violations(entries: DataFrame, date_from, date_to, room=None, limit=None,
                   key_collation: str | None = None) -> DataFrame:
    """R2. Most frequently failed indicators (staff-level rows, grouped by text).
    With ``key_collation`` the counts are first taken per exact spelling (hash
    aggregate), then re-grouped under the collation."""
    d0, d1 = parse_report_date(date_from), parse_report_date(date_to)
    e = _date_window(entries, d0, d1).where(F.col("check_value") == 0)
    r = _room_param(room)
    if r is not None:
        room_col = F.collate(F.col("room_code"), key_collation) if key_collation else F.col("room_code")
        e = e.where(room_col == r)
    keys = ["indicator_text", "category", "scope"]
    g = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("violation_count"))
    if key_collation is not None:
        g = (_collated(g, keys, key_collation).groupBy(*keys)
             .agg(F.sum("violation_count").alias("violation_count")))
        g = g.select(*[F.collate(F.col(k), "UTF8_BINARY").alias(k) for k in keys], "violation_count")
    return (g.orderBy(F.col("violation_count").desc(), F.col("indicator_text").asc_nulls_first(),
                      F.col("category").asc_nulls_first(), scope_order(F.col("scope")))
            .limit(clamp_limit(limit)))


DAILY_COLUMNS = ["id", "batch_id", "slot_code", "staff_id", "staff_name", "scope",
                 "indicator_text", "category", "check_value", "weight", "earned_points",
                 "possible_points", "comment", "submitted_by", "created_at"]


def daily_report(entries: DataFrame, staff: DataFrame, day, room,
                 key_collation: str | None = None) -> DataFrame:
    """R3. All entries of one room on one day, with staff names."""
    d = parse_report_date(day)
    r = _room_param(room)
    if r is None or r == "0":  # the daily report's room test is a falsy test
        raise ValueError("Missing room")
    room_col = F.collate(F.col("room_code"), key_collation) if key_collation else F.col("room_code")
    e = _day(entries, d).where(room_col == r)
    j = e.join(staff.select("staff_id", "staff_name"), "staff_id", "left")
    return (j.orderBy(F.col("slot_code").asc_nulls_first(), scope_order(F.col("scope")),
                      F.col("staff_name").asc_nulls_first(), F.col("id"))
            .select(*DAILY_COLUMNS))


def daily_view(daily: DataFrame) -> DataFrame:
    """R3 as displayed: name falls back to the staff id (F21), the check as a
    Yes/No label (F22), a missing comment as ''."""
    return daily.select(
        "id", "slot_code", F.coalesce(F.col("staff_name"), F.col("staff_id")).alias("display_name"),
        "scope", "indicator_text",
        F.when(F.col("check_value") == 1, "Yes").otherwise("No").alias("check_label"),
        "weight", F.coalesce(F.col("comment"), F.lit("")).alias("comment"))


def kpi_bands(summary: DataFrame) -> DataFrame:
    """C4. Display name and colour band of each percentage of a summary."""
    return summary.select(
        "staff_id", "room_code",
        F.coalesce(F.col("staff_name"), F.col("staff_id")).alias("display_name"),
        "team_kpi", "ind_kpi", "total_kpi",
        kpi_band(F.col("team_kpi")).alias("team_band"),
        kpi_band(F.col("ind_kpi")).alias("ind_band"),
        kpi_band(F.col("total_kpi")).alias("total_band"))

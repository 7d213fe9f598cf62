"""Report properties at sf0.001: paging, monthly vs summary, clamps, collation."""
import datetime as dt
from decimal import Decimal

import pytest

from checkwise.plans import reports
from checkwise.schemas import KPI_ENTRIES, ROOMS, STAFF
from checkwise.sources import testdata as td


@pytest.fixture(scope="module")
def tables(spark, sf_small):
    return td.kpi_entries(spark, sf_small), td.staff(spark, sf_small), td.rooms(spark, sf_small)


def test_clamps():
    assert reports.clamp_page(-1, 999) == (1, 200)
    assert reports.clamp_page(None, None) == (1, 50)
    assert reports.clamp_page("x", 0) == (1, 1)
    assert reports.clamp_page("2abc", " 30 ") == (2, 30)
    assert reports.clamp_limit(500) == 100 and reports.clamp_limit(None) == 20


def test_pages_concatenate_to_whole(spark, tables):
    e, s, r = tables
    whole = [tuple(x) for x in reports.kpi_summary(e, s, r, "1995-01-01", "2001-12-31").collect()]
    pages = []
    for p in range(1, 5):
        pages += [tuple(x) for x in reports.kpi_summary(e, s, r, "1995-01-01", "2001-12-31",
                                                        page=p, per_page=15).collect()]
    assert pages == whole
    assert all(0 <= x[4] <= 100 and 0 <= x[5] <= 100 and 0 <= x[6] <= 100 for x in whole)


def test_has_next_page(spark, tables):
    e, s, r = tables
    n = reports.kpi_summary(e, s, r, "1995-01-01", "2001-12-31").count()
    full_pages = n // 15
    assert reports.has_next_page(e, s, r, "1995-01-01", "2001-12-31", page=full_pages, per_page=15)
    assert not reports.has_next_page(e, s, r, "1995-01-01", "2001-12-31", page=full_pages + 1, per_page=15) \
        or n % 15 == 0


def test_monthly_equals_summary_of_month(spark, tables):
    e, s, r = tables
    m = [tuple(x) for x in reports.kpi_monthly(e, s, r, 1997, 4).drop("total_batches").collect()]
    sm = [tuple(x) for x in reports.kpi_summary(e, s, r, "04-01-1997", "1997-04-30").collect()]
    assert m == sm and len(m) > 0


def test_monthly_validates_month(spark, tables):
    e, s, r = tables
    with pytest.raises(ValueError):
        reports.kpi_monthly(e, s, r, 1997, 13)
    with pytest.raises(ValueError):
        reports.kpi_monthly(e, s, r, 0, 4)


def test_daily_requires_room(spark, tables):
    e, s, _ = tables
    for bad in (None, "", "  ", "0"):
        with pytest.raises(ValueError):
            reports.daily_report(e, s, "1997-04-15", bad)


def test_from_after_to_is_empty(spark, tables):
    e, s, r = tables
    assert reports.kpi_summary(e, s, r, "2000-01-02", "2000-01-01").count() == 0


def test_violations_group_by_text_across_rooms(spark):
    rows = []
    for i, room in enumerate(["Pink", "Blue", "Pink"]):
        rows.append((i, "B", dt.date(2026, 4, 20), room, "AM", f"s{i}", "Team", i, "Same text", "C", 0,
                     Decimal(1), Decimal(0), Decimal(1), None, None, dt.datetime(2026, 4, 20)))
    e = spark.createDataFrame(rows, KPI_ENTRIES)
    got = [tuple(x) for x in reports.top_violations(e, "2026-04-01", "2026-04-30").collect()]
    assert got == [("Same text", "C", "Team", 3)]
    assert [tuple(x) for x in reports.top_violations(e, "2026-04-01", "2026-04-30", room=" Blue ").collect()] == \
        [("Same text", "C", "Team", 1)]


def test_collation_merges_case_and_trailing_spaces(spark):
    def row(i, room, scope="Team"):
        return (i, "B", dt.date(2026, 4, 20), room, "AM", "st_1", scope, i, "t", "c", 1,
                Decimal(1), Decimal(1), Decimal(1), None, None, dt.datetime(2026, 4, 20))
    e = spark.createDataFrame([row(1, "Pink"), row(2, "pink  "), row(3, "PÏNK")], KPI_ENTRIES)
    st = spark.createDataFrame([("st_1", "Ann", None, None, 1)], STAFF)
    rm = spark.createDataFrame([("Pink", "Pink Room", 1, 1)], ROOMS)
    plain = reports.kpi_summary(e, st, rm, "2026-04-01", "2026-04-30")
    assert plain.count() == 3
    coll = reports.kpi_summary(e, st, rm, "2026-04-01", "2026-04-30", key_collation="UNICODE_CI_AI_RTRIM")
    rows = coll.collect()
    assert len(rows) == 1 and rows[0].is_admin == 1 and rows[0].staff_name == "Ann"
    assert rows[0].room_code == "pink" and rows[0].team_kpi == 100.0
    m = reports.kpi_monthly(e, st, rm, 2026, 4, key_collation="UNICODE_CI_AI_RTRIM").collect()
    assert len(m) == 1 and m[0].total_batches == 1


def test_daily_order_enum_nulls_and_ties(spark):
    """T3 Team before Individual, T4 unknown staff (NULL name) first, T22 id tiebreak."""
    def row(i, slot, staff, scope):
        return (i, "B", dt.date(2026, 4, 20), "Pink", slot, staff, scope, i, "t", "c", 1,
                Decimal(1), Decimal(1), Decimal(1), None, None, dt.datetime(2026, 4, 20))
    e = spark.createDataFrame([row(1, "PM", "a", "Team"), row(2, "AM", "a", "Individual"),
                               row(3, "AM", "zz", "Team"), row(4, "AM", "a", "Team"),
                               row(5, "AM", "a", "Team")], KPI_ENTRIES)
    st = spark.createDataFrame([("a", "Ann", None, None, 0)], STAFF)   # inactive staff still shown
    got = [(r.id, r.staff_name) for r in reports.daily_report(e, st, "04-20-2026", "Pink").collect()]
    assert got == [(3, None), (4, "Ann"), (5, "Ann"), (2, "Ann"), (1, "Ann")]


def test_collation_in_violations_and_daily(spark):
    def row(i, room, text):
        return (i, "B", dt.date(2026, 4, 20), room, "AM", "s", "Team", i, text, "C", 0,
                Decimal(1), Decimal(0), Decimal(1), None, None, dt.datetime(2026, 4, 20))
    e = spark.createDataFrame([row(1, "Pink", "Door shut"), row(2, "pink ", "door shut"),
                               row(3, "Blue", "Door Shut  ")], KPI_ENTRIES)
    plain = reports.top_violations(e, "2026-04-01", "2026-04-30").collect()
    assert len(plain) == 3
    c = reports.top_violations(e, "2026-04-01", "2026-04-30", key_collation="UNICODE_CI_AI_RTRIM").collect()
    assert len(c) == 1 and c[0].violation_count == 3
    c2 = reports.top_violations(e, "2026-04-01", "2026-04-30", room="PINK",
                                key_collation="UNICODE_CI_AI_RTRIM").collect()
    assert c2[0].violation_count == 2
    st = spark.createDataFrame([("s", "Sam", None, None, 1)], STAFF)
    assert reports.daily_report(e, st, "2026-04-20", "PINK").count() == 0
    assert reports.daily_report(e, st, "2026-04-20", "PINK", key_collation="UNICODE_CI_AI_RTRIM").count() == 2

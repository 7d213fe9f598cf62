"""Config reads R5, checklist C1, staff by room C2, completeness C3, loads I5."""
from decimal import Decimal

from pyspark.sql import functions as F

from checkwise.plans import config, dimensions, quality
from checkwise.schemas import INDICATORS, STAFF

IND = [(1, "*", "*", "Team", "c", "t1", Decimal(1), 2, 1),
       (2, "Pink", "AM", "Team", "c", "t2", Decimal(1), 1, 1),
       (3, "Blue", "*", "Team", "c", "t3", Decimal(1), 3, 1),
       (4, "*", "PM", "Individual", "c", "t4", Decimal(1), 1, 1),
       (5, "*", "*", "Team", "c", "t5", Decimal(1), 0, 0)]


def test_checklist_wildcards(spark):
    ind = spark.createDataFrame(IND, INDICATORS)
    assert [r.id for r in config.checklist(ind, "Pink", "AM", "Team").collect()] == [2, 1]
    assert [r.id for r in config.checklist(ind, "Pink", "PM", "Individual").collect()] == [4]
    ctx = spark.createDataFrame([("Pink", "AM"), ("Blue", "PM")], "room_code string, slot_code string")
    got = sorted((r.room_code, r.slot_code, r.indicator_id) for r in config.checklists(ctx, ind).collect())
    assert got == [("Blue", "PM", 1), ("Blue", "PM", 3), ("Blue", "PM", 4), ("Pink", "AM", 1), ("Pink", "AM", 2)]


def test_staff_by_room(spark):
    st = spark.createDataFrame([("a", "A", None, None, 1), ("b", "B", None, "Blue, Pink", 1),
                                ("c", "C", None, "PinkRoom", 1), ("d", "D", None, "", 1),
                                ("e", "E", None, "Pink", 0)], STAFF)
    assert [r.staff_id for r in config.staff_by_room(st, "Pink").collect()] == ["a", "b", "d"]


def test_completeness(spark):
    import datetime as dt
    from checkwise.schemas import KPI_ENTRIES
    ind = spark.createDataFrame(IND, INDICATORS)

    def e(batch, room, slot, scope, iid):
        return (1, batch, dt.date(2026, 4, 20), room, slot, "s", scope, iid, "t", "c", 1,
                Decimal(1), Decimal(1), Decimal(1), None, None, dt.datetime(2026, 4, 20))
    entries = spark.createDataFrame([e("B1", "Pink", "AM", "Team", 1), e("B1", "Pink", "AM", "Team", 2),
                                     e("B2", "Pink", "AM", "Team", 1), e("B2", "Pink", "AM", "Team", 3),
                                     e("B2", "Pink", "AM", "Individual", 2)], KPI_ENTRIES)
    got = sorted((r.batch_id, r.expected_items, r.answered_items, r.unanswered_items)
                 for r in quality.checklist_completeness(entries, ind).collect())
    assert got == [("B1", 2, 2, 0), ("B2", 2, 1, 1)]


def test_load_dimension_first_wins_and_indicator_append(spark):
    st = spark.createDataFrame([("a", "Old A", None, None, 1)], STAFF)
    new = spark.createDataFrame([("a", "New A", None, None, 1, 1), ("b", "B1", None, None, 1, 2),
                                 ("b", "B2", None, None, 1, 3)], STAFF.simpleString()[7:-1] + ", seq int")
    table, added = dimensions.load_dimension(st, new, ["staff_id"], [F.col("seq")])
    assert sorted((r.staff_id, r.staff_name) for r in table.collect()) == [("a", "Old A"), ("b", "B1")]
    ind = spark.createDataFrame(IND[:2], INDICATORS)
    table2, _ = dimensions.load_dimension(ind, ind, None)
    assert table2.count() == 4
    assert dimensions.audit_row([new, ind]).collect()[0].rows_saved == 5
    assert added.count() == 1

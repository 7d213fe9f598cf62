"""End-to-end use of the store facade: seed, save, report, import, backup."""
import datetime as dt
import json
import os
import tempfile
from decimal import Decimal


from checkwise.api import KpiStore
from checkwise.plans import sinks
from checkwise.schemas import INDICATORS, ROOMS, SLOTS, STAFF


def test_store_flow(spark):
    base = tempfile.mkdtemp(prefix="checkwise-store-")
    store = KpiStore(spark, base)
    added = store.seed(
        rooms=spark.createDataFrame([("Pink", "Pink Room", 0, 1), ("Admin", "Admin", 1, 1)], ROOMS),
        slots=spark.createDataFrame([("AM", "Morning", "AM", 1, 1)], SLOTS),
        staff=spark.createDataFrame([("a", "Ann", None, "Pink", 1), ("b", "Bob", None, None, 1)], STAFF),
        indicators=spark.createDataFrame([(1, "*", "*", "Team", "c", "Door", Decimal(2), 1, 1),
                                          (2, "Pink", "*", "Individual", "c", "Hands", Decimal(1), 2, 1)],
                                         INDICATORS))
    assert added == {"rooms": 2, "slots": 1, "staff": 2, "indicators": 2}
    # seeding again keeps stored rooms, appends indicators again
    store.seed(rooms=spark.createDataFrame([("Pink", "Renamed", 0, 1)], ROOMS))
    assert [r.room_name for r in store.dimension("rooms").where("room_code = 'Pink'").collect()] == ["Pink Room"]

    payload = {"batch_id": "B-1", "date": "04-20-2026", "room_code": "Pink", "slot_code": "AM",
               "present_staff_ids": ["a", "b"], "team_items": [{"indicator_id": 1, "check": "yes"}],
               "individual_items": {"a": [{"indicator_id": 2, "check": "no", "comment": "late"}]}}
    subs = spark.createDataFrame([(1, json.dumps(payload), "mgr", "10.0.0.1")],
                                 "seq long, payload string, submitted_by string, ip string")
    store.save_batches(subs)
    store.save_batches(subs)  # a resubmission saves nothing new
    assert store.entries().count() == 3
    s = {(r.staff_id, r.team_kpi, r.ind_kpi, r.total_kpi) for r in store.summary("2026-04-01", "2026-04-30").collect()}
    assert s == {("a", 100.0, 0.0, 80.0), ("b", 100.0, 0.0, 100.0)}
    assert [tuple(r) for r in store.violations("2026-04-01", "2026-04-30").collect()] == [("Hands", "c", "Individual", 1)]
    d = store.daily("2026-04-20", "Pink").collect()
    assert len(d) == 3 and all(r.id is not None and r.created_at is not None for r in d)
    assert [r.total_batches for r in store.monthly(2026, 4).collect()] == [1, 1]
    ids = spark.createDataFrame([("B-1",), ("B-2",)], "batch_id string")
    assert sorted(tuple(r) for r in store.check_duplicate(ids).collect()) == [("B-1", 1), ("B-2", 0)]
    assert {k: v.count() for k, v in store.config().items()} == {"rooms": 2, "slots": 1, "staff": 2, "indicators": 2}

    src = os.path.join(base, "in")
    os.makedirs(src)
    with open(os.path.join(src, "k.csv"), "w") as f:
        f.write("Date,Room,Slot,Staff ID,Type,KPI Indicator,Category,Result,Weight\n"
                "4/21/2026,Pink,AM,b,Team,Door,c,No,2\n")
    r = store.import_csv(src)
    assert r.stats.collect()[0].imported == 1
    assert store.entries().count() == 4
    paths = store.backup(dt.date(2026, 4, 30))
    assert spark.read.parquet(paths["kpi_entries"]).count() == 4
    out = os.path.join(base, "summary.json")
    sinks.export_json(store.summary("2026-04-01", "2026-04-30"), out)
    got = [json.loads(line) for name in sorted(os.listdir(out)) if name.endswith(".json")
           for line in open(os.path.join(out, name))]
    assert {g["staff_id"] for g in got} == {"a", "b"}

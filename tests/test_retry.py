"""Retried and partial loads of the store."""
import json
import tempfile
from decimal import Decimal

from checkwise.api import KpiStore
from checkwise.schemas import INDICATORS


def _store(spark):
    store = KpiStore(spark, tempfile.mkdtemp(prefix="checkwise-retry-"))
    store.seed(indicators=spark.createDataFrame([(1, "*", "*", "Team", "c", "Door", Decimal(2), 1, 1)], INDICATORS))
    return store


def _subs(spark, batch, present, indicator=1):
    payload = {"batch_id": batch, "date": "05-02-2026", "room_code": "Pink", "slot_code": "AM",
               "present_staff_ids": present, "team_items": [{"indicator_id": indicator, "check": "yes"}],
               "individual_items": {}}
    return spark.createDataFrame([(1, json.dumps(payload), "m", "10.0.0.9")],
                                 "seq long, payload string, submitted_by string, ip string")


def test_retry_keeps_its_own_rows(spark):
    store = _store(spark)
    store.save_batches(_subs(spark, "B", ["a"]), load_id="L")
    store.save_batches(_subs(spark, "B", ["a", "b"]), load_id="L")
    assert sorted(r.staff_id for r in store.entries().collect()) == ["a", "b"]
    assert sorted(r.staff_id for r in store.presence().collect()) == ["a", "b"]


def test_quoted_csv_and_largest_weight(spark, tmp_path):
    store = _store(spark)
    (tmp_path / "k.csv").write_text(
        "Date,Room,Slot,Staff ID,Type,KPI Indicator,Category,Result,Weight\n"
        '4/21/2026,Pink,AM,b,Team,"Sign ""Exit"" lit, ok",Saf,No,2\n'
        "4/21/2026,Pink,AM,b,Team,Door,c,No,999.995\n")
    r = store.import_csv(str(tmp_path))
    assert [(x.indicator_text, x.category, x.weight) for x in r.entries.collect()] == [
        ('Sign "Exit" lit, ok', "Saf", Decimal("2.00"))]
    assert [x.reason for x in r.rejects.collect()] == ["Weight out of range"]

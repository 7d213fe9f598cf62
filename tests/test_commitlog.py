"""Loads appear all at once or not at all; ids; snapshots of one version."""
import datetime as dt
import json
import random
import tempfile
from decimal import Decimal

import pytest

from checkwise.api import KpiStore
from checkwise.plans import reports, sinks, snapshot
from checkwise.schemas import INDICATORS, ROOMS
from checkwise.sources import commitlog
from checkwise.sources.commitlog import CommitConflict, CommitLog, Load

TABLES = (sinks.ENTRIES, sinks.PRESENCE_TABLE, sinks.AUDIT_TABLE, sinks.REJECTS, sinks.BATCH_INDEX)


def _store(spark):
    store = KpiStore(spark, tempfile.mkdtemp(prefix="checkwise-log-"))
    store.seed(indicators=spark.createDataFrame([(i, "*", "*", "Team", "c", f"Door {i}", Decimal(2), 1, 1) for i in range(5)], INDICATORS))
    return store


def _subs(spark, *batches, present=("a", "b"), day="05-02-2026"):
    rows = [(i, json.dumps({"batch_id": b, "date": day, "room_code": "Pink", "slot_code": "AM", "present_staff_ids": list(present),
                            "team_items": [{"indicator_id": k, "check": "yes"} for k in range(3)], "individual_items": {}}), "m", "ip")
            for i, b in enumerate(batches)]
    return spark.createDataFrame(rows, "seq long, payload string, submitted_by string, ip string")


def _content(store, version=None):
    """Every table's rows as of a version."""
    out = {}
    for t in TABLES:
        df = store.log.read(t, version)
        out[t] = sorted(map(str, df.drop("created_at").where("load_id not like 'seed%'").collect())) if df is not None else []
    return out


class Stopped(Exception):
    pass


@pytest.mark.parametrize("at", [2, 6])
def test_stopped_load_is_invisible(spark, monkeypatch, at):
    """Stopped before each table's write, and before the commit: no report sees anything of it; a retry gives the rows."""
    store = _store(spark)
    store.save_batches(_subs(spark, "B0"), load_id="L0")
    before, report = _content(store), store.summary("2026-05-01", "2026-05-31").collect()
    write, commit, count = Load.write, Load.commit, [0]

    def stopping(real):
        def call(self, *a, **k):
            count[0] += 1
            if count[0] == at + 1:
                raise Stopped
            return real(self, *a, **k)
        return call

    monkeypatch.setattr(Load, "write", stopping(write))
    monkeypatch.setattr(Load, "commit", stopping(commit))
    with pytest.raises(Stopped):
        store.save_batches(_subs(spark, "B1", "B2"), load_id="L1")
    monkeypatch.undo()
    assert _content(store) == before
    assert store.summary("2026-05-01", "2026-05-31").collect() == report
    assert [r.exists for r in store.check_duplicate(spark.createDataFrame([("B1",)], "batch_id string")).collect()] == [0]
    store.save_batches(_subs(spark, "B1", "B2"), load_id="L1")
    clean = _store(spark)
    clean.save_batches(_subs(spark, "B0"), load_id="L0")
    clean.save_batches(_subs(spark, "B1", "B2"), load_id="L1")
    assert _content(store) == _content(clean)
    assert len(store.log.unreferenced()) == at  # folders of the stopped attempt, read by no version


def test_retry_replaces_and_keeps_ids(spark):
    store = _store(spark)
    store.save_batches(_subs(spark, "B0", "B1"), load_id="L0")
    store.save_batches(_subs(spark, "B2"), load_id="L1")
    first = _content(store)
    version = store.log.head()
    store.save_batches(_subs(spark, "B0", "B1"), load_id="L0")
    assert _content(store) == first  # the same rows with the same ids
    assert _content(store, version) == first
    ids = sorted(r.id for r in store.entries().collect())
    assert ids == list(range(1, 19))
    store.save_batches(_subs(spark, "B0", "B1", present=("a", "b", "c")), load_id="L0")  # more rows: a new block
    ids = [r.id for r in store.entries().collect()]
    assert len(ids) == len(set(ids)) == 24
    assert _content(store, version) == first  # the older version is still there


def test_conflicting_load_is_computed_again(spark):
    store = _store(spark)
    real, other = sinks.write_result, []

    def interrupted(result, load):
        if not other:  # another load stores the same batch between this one's reading and its commit
            other.append(1)
            store.save_batches(_subs(spark, "B0", present=("a",)), load_id="other")
        return real(result, load)

    sinks.write_result, keep = interrupted, real
    try:
        store.save_batches(_subs(spark, "B0"), load_id="mine")
    finally:
        sinks.write_result = keep
    keys = [(r.batch_id, r.staff_id, r.indicator_id) for r in store.entries().collect()]
    assert len(keys) == len(set(keys)) == 6
    assert sorted(r.rows_saved for r in store.audit().where("action <> 'seed_config'").collect()) == [3, 3]


def test_conflicts_and_blocks(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    df = spark.range(3)
    a, b, c = log.begin("a", ("t",)), log.begin("b", ("t",)), log.begin("c", ("other",))
    firsts = [x.reserve_ids(n) for x, n in ((a, 10), (b, 5), (c, 1))]
    assert firsts == [1, 11, 16] and a.reserve_ids(7) == 1 and a.reserve_ids(11) == 17
    for x in (a, b, c):
        x.write("t", df)
    a.commit()
    with pytest.raises(CommitConflict):
        b.commit()
    c.commit()
    assert log.read("t").groupBy("load_id").count().count() == 2
    assert log.read("t", without_load="a").count() == 3
    assert log.read("none") is None
    assert CommitLog(spark, str(tmp_path))._publish(f"{log.head():020d}.json", {}) is False  # a version is published once


def test_states_equal_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "STATE_EVERY", 3)
    log = CommitLog(spark, str(tmp_path))
    for i in range(8):
        load = log.begin(f"load {i % 5}/é")
        load.reserve_ids(2)
        load.write("t", spark.range(i + 1))
        load.commit()
    fresh = CommitLog(spark, str(tmp_path))
    assert any(n.endswith(".state") for n in fresh._names())
    for v in range(log.head() + 1):
        assert vars(fresh.state(v)) == vars(log.state(v))
    assert {r.load_id: r["count"] for r in fresh.read("t").groupBy("load_id").count().collect()} == {
        "load 0/é": 6, "load 1/é": 7, "load 2/é": 8, "load 3/é": 4, "load 4/é": 5}


def test_seed_is_atomic(spark, monkeypatch):
    store = _store(spark)
    rooms = spark.createDataFrame([("Pink", "Pink Room", 0, 1)], ROOMS)
    store.seed(rooms=rooms)
    write = Load.write

    def stopping(self, table, *a, **k):
        if table == "indicators":
            raise Stopped
        return write(self, table, *a, **k)

    monkeypatch.setattr(Load, "write", stopping)
    more = spark.createDataFrame([("Blue", "Blue Room", 0, 1)], ROOMS)
    with pytest.raises(Stopped):
        store.seed(rooms=more, indicators=store.dimension("indicators"))
    monkeypatch.undo()
    assert [r.room_code for r in store.dimension("rooms").collect()] == ["Pink"]
    assert store.dimension("indicators").count() == 5
    assert sorted(r.rows_saved for r in store.audit().collect()) == [1, 5]


def test_months_open_only_their_loads(spark):
    store = _store(spark)
    store.save_batches(_subs(spark, "B0"), load_id="may")
    store.save_batches(_subs(spark, "B1", day="07-02-2026"), load_id="july")
    files = store.entries(months=("2026-07-01", "2026-07-01")).inputFiles()
    assert files and all("load_id=july" in f for f in files)
    assert store.summary("2026-07-01", "2026-07-31").count() == 2


def test_snapshot_of_one_version(spark, tmp_path, monkeypatch):
    """A load that commits while the backup runs is in none of its tables; a restore checks every file."""
    store = _store(spark)
    store.save_batches(_subs(spark, "B0"), load_id="L0")
    want = _content(store)
    real = snapshot.write_snapshot

    def meanwhile(tables, base, day):
        store.save_batches(_subs(spark, "B1"), load_id="L1")
        return real(tables, base, day)

    monkeypatch.setattr(snapshot, "write_snapshot", meanwhile)
    day, base = dt.date(2026, 5, 3), f"{store.base}/backups"
    paths = store.backup(day)
    monkeypatch.undo()
    assert {t: spark.read.parquet(p).count() for t, p in paths.items() if t in TABLES} == {
        t: len(rows) + (t == sinks.AUDIT_TABLE) for t, rows in want.items()}  # with the seed's audit row
    assert snapshot.verify(spark, base, day).count() == 0
    back = CommitLog(spark, str(tmp_path))
    snapshot.restore(back, base, day)
    assert sorted(map(str, back.read(sinks.ENTRIES).drop("load_id", "created_at").collect())) == sorted(
        map(str, store.log.read(sinks.ENTRIES, without_load="L1").drop("load_id", "created_at").collect()))
    assert back.begin("next").reserve_ids(1) > max(r.id for r in back.read(sinks.ENTRIES).collect())
    # a damaged file is found, and nothing is restored
    entries = spark.read.parquet(paths[sinks.ENTRIES]).limit(2).collect()
    schema = spark.read.parquet(paths[sinks.ENTRIES]).schema
    spark.createDataFrame(entries, schema).write.mode("append").parquet(paths[sinks.ENTRIES])
    assert snapshot.verify(spark, base, day).count() > 0
    with pytest.raises(ValueError, match="damaged"):
        snapshot.restore(back, base, day)


def test_rollup_equals_entries(spark):
    """Random loads, retries and rewrites: the summary from the roll-ups is the summary of the entries."""
    g = random.Random(8)
    store = _store(spark)
    for _ in range(4):
        batches = [f"B{g.randrange(6)}" for _ in range(g.randrange(1, 4))]
        store.save_batches(_subs(spark, *batches, present=g.sample(["a", "b", "c"], 2), day=f"0{g.randrange(4, 7)}-0{g.randrange(1, 9)}-2026"),
                           load_id=f"L{g.randrange(2)}")
    for d0, d1, room in (("2026-04-01", "2026-06-30", None), ("2026-04-04", "2026-05-05", "Pink"), ("2027-01-01", "2027-01-02", None)):
        want = reports.kpi_summary(store.entries(), store.dimension("staff"), store.dimension("rooms"), d0, d1, room=room).collect()
        assert store.summary(d0, d1, room=room).collect() == want
    files = store.summary("2026-04-01", "2026-06-30").inputFiles()
    assert any("/kpi_rollup/" in f for f in files) and not any("/kpi_entries/" in f for f in files)

"""The operations of the reference's API and scripts over a folder of stored
tables, as Spark DataFrames.

    store = KpiStore(spark, "hdfs:///kpi")           # any shared folder
    store.seed(rooms=..., slots=..., staff=..., indicators=...)
    store.save_batches(submissions)                  # saveBatch, many at once
    store.summary("2026-04-01", "2026-04-30", room="Pink", page=1)
    store.violations(...), store.daily(...), store.monthly(2026, 4)
    store.config()                                   # active dimensions
    store.check_duplicate(batch_ids)                 # checkDuplicate, many at once
    store.import_history(path), store.import_csv(path)
    store.backup(date)

Every write is a load with its own ``load_id``: all its tables appear with one
commit, or none (``sources/commitlog``), and a retried load replaces its own rows.
Reads see the newest committed version; ``KpiStore(spark, base, version=7)`` reads
an older one."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkwise.plans import config as cfg
from checkwise.plans import dimensions, imports, ingest, quality, reports, rollup, sinks, snapshot
from checkwise.schemas import AUDIT, INDICATORS, KPI_ENTRIES_STORED, PRESENCE, ROOMS, SLOTS, STAFF
from checkwise.sources import files
from checkwise.sources.commitlog import CommitLog, Load

DIM_SCHEMAS = {"rooms": ROOMS, "slots": SLOTS, "staff": STAFF, "indicators": INDICATORS}


class KpiStore:
    def __init__(self, spark: SparkSession, base: str, version: int | None = None):
        self.spark = spark
        self.base = base.rstrip("/")
        self.log = CommitLog(spark, self.base)
        self.version = version

    # --- tables -------------------------------------------------------------
    def _read(self, name: str, schema, load: Load | None = None, **options) -> DataFrame:
        df = load.read(name, **options) if load else self.log.read(name, self.version, **options)
        return df if df is not None else self.spark.createDataFrame([], schema)

    def dimension(self, name: str, load: Load | None = None) -> DataFrame:
        return self._read(name, DIM_SCHEMAS[name], load).select(*DIM_SCHEMAS[name].fieldNames())

    def entries(self, load: Load | None = None, months: tuple[str, str] | None = None) -> DataFrame:
        return self._read(sinks.ENTRIES, KPI_ENTRIES_STORED, load, months=months)

    def presence(self, load: Load | None = None) -> DataFrame:
        return self._read(sinks.PRESENCE_TABLE, PRESENCE, load)

    def audit(self) -> DataFrame:
        return self._read(sinks.AUDIT_TABLE, AUDIT)

    def batch_index(self, load: Load | None = None) -> DataFrame | None:
        return load.read(sinks.BATCH_INDEX) if load else self.log.read(sinks.BATCH_INDEX, self.version)

    def _range(self, date_from, date_to) -> DataFrame:
        """Entries of the loads that hold a month of the range."""
        return self.entries(months=(f"{str(date_from)[:7]}-01", f"{str(date_to)[:7]}-01"))

    # --- reference data ------------------------------------------------------
    def seed(self, **tables: DataFrame) -> dict[str, int]:
        """I5: first-wins load of rooms/slots/staff (by primary key, ``seq``
        column optional for order), plain append of indicators."""
        load = self.log.begin(f"seed-{uuid.uuid4().hex[:12]}", tuple(tables))
        added_counts = {}
        for name, rows in tables.items():
            order = [F.col("seq")] if "seq" in rows.columns else None
            table, added = dimensions.load_dimension(self.dimension(name, load), rows, dimensions.PRIMARY_KEYS.get(name), order)
            added_counts[name] = added.count()
            load.write(name, table, replace=True)
        load.write(sinks.AUDIT_TABLE, dimensions.audit_row(list(tables.values())))
        load.commit()  # all tables, or none
        return added_counts

    def config(self) -> dict[str, DataFrame]:
        """R5: the active rooms, slots, staff and indicators."""
        return {"rooms": cfg.active_rooms(self.dimension("rooms")),
                "slots": cfg.active_slots(self.dimension("slots")),
                "staff": cfg.active_staff(self.dimension("staff")),
                "indicators": cfg.active_indicators(self.dimension("indicators"))}

    def checklist(self, room: str, slot: str, scope: str) -> DataFrame:
        return cfg.checklist(self.dimension("indicators"), room, slot, scope)

    def staff_for_room(self, room: str) -> DataFrame:
        return cfg.staff_by_room(self.dimension("staff"), room)

    # --- reports ---------------------------------------------------------------
    def summary(self, date_from, date_to, room=None, page=1, per_page=50) -> DataFrame:
        months = (f"{str(date_from)[:7]}-01", f"{str(date_to)[:7]}-01")
        state = self.log.state(self.version)
        if state.of(sinks.ENTRIES) and {p.load for p in state.of(sinks.ENTRIES)} == {p.load for p in state.of(rollup.TABLE)}:
            sums = self.log.read(rollup.TABLE, self.version, months=months)
            if sums is not None:
                return rollup.kpi_summary(sums, self.dimension("staff"), self.dimension("rooms"), date_from, date_to,
                                          room=room, page=page, per_page=per_page)
        return reports.kpi_summary(self._range(date_from, date_to), self.dimension("staff"), self.dimension("rooms"),
                                   date_from, date_to, room=room, page=page, per_page=per_page)

    def has_next_page(self, date_from, date_to, room=None, page=1, per_page=50) -> bool:
        return reports.has_next_page(self._range(date_from, date_to), self.dimension("staff"), self.dimension("rooms"),
                                     date_from, date_to, room=room, page=page, per_page=per_page)

    def violations(self, date_from, date_to, room=None, limit=20) -> DataFrame:
        return reports.top_violations(self._range(date_from, date_to), date_from, date_to, room=room, limit=limit)

    def daily(self, day, room) -> DataFrame:
        return reports.daily_report(self.entries(), self.dimension("staff"), day, room)

    def monthly(self, year, month, room=None) -> DataFrame:
        return reports.kpi_monthly(self.entries(), self.dimension("staff"), self.dimension("rooms"),
                                   year, month, room=room)

    def completeness(self) -> DataFrame:
        return quality.checklist_completeness(self.entries(), self.dimension("indicators"))

    # --- writes ----------------------------------------------------------------
    def save_batches(self, submissions: DataFrame, load_id: str | None = None) -> ingest.IngestResult:
        """I1 for a set of submissions (seq, payload, submitted_by, ip); commits
        entries, presence, audit and rejects under one load id."""
        load_id = load_id or f"ingest-{uuid.uuid4().hex[:12]}"
        return save_batches(self, submissions, load_id)

    def check_duplicate(self, batch_ids: DataFrame) -> DataFrame:
        """I2 for many ids: (batch_id, exists)."""
        index = self.batch_index()
        return ingest.batch_exists(batch_ids, index if index is not None else self.entries())

    def import_history(self, path: str, load_id: str | None = None, array: bool = False) -> imports.ImportResult:
        """I3 from files of JSON Lines, or with ``array`` from files that hold one JSON array each."""
        load_id = load_id or f"history-{uuid.uuid4().hex[:12]}"
        records = files.read_history_array(self.spark, path) if array else files.read_json_lines(self.spark, path)
        return sinks.run_load(self.log, load_id, (sinks.PRESENCE_TABLE,),
                              lambda load: imports.import_history(records, self.presence(load)))

    def import_csv(self, path: str, load_id: str | None = None) -> imports.ImportResult:
        """I4 from headered CSV files (record numbers per file)."""
        load_id = load_id or f"csv-{uuid.uuid4().hex[:12]}"
        lines = files.read_csv_text(self.spark, path)
        header = files.read_csv_header(self.spark, path, lines)
        return sinks.run_load(self.log, load_id, (sinks.PRESENCE_TABLE,),
                              lambda load: imports.import_csv(files.csv_data_lines(lines), header, self.presence(load)))

    def backup(self, day: dt.date | None = None) -> dict[str, str]:
        """B1: dated gzip snapshot of every table, all of them as of one version."""
        return snapshot.write_committed(self.log, f"{self.base}/backups", day or dt.date.today(), self.version)


def save_batches(store: KpiStore, submissions: DataFrame, load_id: str) -> ingest.IngestResult:
    """I1 as one load of the store."""
    return sinks.run_load(
        store.log, load_id, (sinks.ENTRIES, sinks.PRESENCE_TABLE, sinks.BATCH_INDEX, "indicators"),
        lambda load: ingest.ingest_submissions(submissions, store.dimension("indicators", load), store.entries(load),
                                               store.presence(load), batch_index=store.batch_index(load)))

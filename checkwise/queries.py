"""Registry of the queries run by the driver, bench and tests.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
input tables (or tables Spark derives from them)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkwise import params as P
from checkwise.plans import config, dimensions, imports, ingest, quality, reports, rollup, sinks, snapshot
from checkwise.schemas import ENTRY_COLUMNS
from checkwise.sources import files, raw, store
from checkwise.sources import testdata as td
from checkwise.sources.commitlog import CommitLog

Query = Callable[[SparkSession, str], DataFrame]


def _whole_range(entries: DataFrame) -> tuple[str, str]:
    """The first and the last day that the fact table holds."""
    first = entries.agg(F.min("entry_date").cast("string").alias("a"), F.max("entry_date").cast("string").alias("b")).first()
    return (first.a, first.b) if first.a else ("1970-01-01", "1970-01-01")


def _summary(room=None, page=None, per_page=None) -> Query:
    def q(spark, sf):
        entries = td.kpi_entries(spark, sf)
        return reports.kpi_summary(entries, td.staff(spark, sf), td.rooms(spark, sf), *_whole_range(entries),
                                   room=room, page=page, per_page=per_page)
    return q


def _monthly(room=None) -> Query:
    def q(spark, sf):
        return reports.kpi_monthly(td.kpi_entries(spark, sf), td.staff(spark, sf), td.rooms(spark, sf),
                                   P.YEAR, P.MONTH, room=room)
    return q


def _violations(room=None) -> Query:
    def q(spark, sf):
        entries = td.kpi_entries(spark, sf)
        return reports.top_violations(entries, *_whole_range(entries), room=room, limit=P.LIMIT)
    return q


def _daily(spark, sf):
    return reports.daily_report(td.kpi_entries(spark, sf), td.staff(spark, sf), P.DAY_US, P.ROOM)


def _bands(spark, sf):
    return reports.kpi_bands(_summary()(spark, sf))


def _ingest(spark, sf):
    return ingest.ingest_submissions(raw.submissions(spark, sf), td.indicators(spark, sf),
                                     raw.stored_entries(spark, sf), raw.stored_presence(spark, sf),
                                     batch_index=raw.stored_batch_index(spark, sf))


def _batch_exists(spark, sf):
    return ingest.batch_exists(raw.probe_batches(spark, sf), raw.stored_batch_index(spark, sf))


def _history(spark, sf):
    return imports.import_history(raw.history_lines(spark, sf), raw.stored_presence(spark, sf))


def _csv(spark, sf):
    return imports.import_csv(raw.csv_lines(spark, sf), raw.CSV_HEADER, raw.stored_presence(spark, sf))


def _collated(spark, sf):
    return reports.kpi_summary(raw.entries_with_mixed_keys(spark, sf), td.staff(spark, sf),
                               td.rooms(spark, sf), *_whole_range(td.kpi_entries(spark, sf)),
                               key_collation=P.COLLATION)


def _monthly_collated(spark, sf):
    return reports.kpi_monthly(raw.entries_with_mixed_keys(spark, sf), td.staff(spark, sf),
                               td.rooms(spark, sf), P.YEAR, P.MONTH, key_collation=P.COLLATION)


def _checklist_contexts(spark, sf):
    contexts = td.kpi_entries(spark, sf).select("room_code", "slot_code")
    return config.checklists(contexts, td.indicators(spark, sf))


def _load_dimension(spark, sf):
    table, _added = dimensions.load_dimension(td.staff(spark, sf), raw.staff_load_batch(spark, sf),
                                              dimensions.PRIMARY_KEYS["staff"], [F.col("seq")])
    return table


def _snapshot(spark, sf):
    base = store.scratch_path(spark, "snapshots")
    day = dt.date.fromisoformat(P.SNAPSHOT_DAY)
    entries = td.kpi_entries(spark, sf).drop("entry_month")
    snapshot.write_snapshot({"kpi_entries": entries}, base, day)
    return snapshot.read_snapshot(spark, base, day, "kpi_entries")


def _csv_file(spark, sf):
    path = raw.csv_files(spark, sf)
    lines = files.read_csv_text(spark, path)
    return imports.import_csv(files.csv_data_lines(lines), files.read_csv_header(spark, path, lines), raw.stored_presence(spark, sf))


def _history_array(spark, sf):
    records = files.read_history_array(spark, raw.history_array_files(spark, sf))
    return imports.import_history(records, raw.stored_presence(spark, sf))


def _stored_log(spark, sf, name):
    """A store that holds the stored tables as its first load."""
    log = CommitLog(spark, store.scratch_path(spark, name))
    entries = raw.stored_entries(spark, sf)
    first = log.begin("stored")
    first.write(sinks.ENTRIES, entries, ("entry_month",))
    first.write(sinks.PRESENCE_TABLE, raw.stored_presence(spark, sf))
    first.write(sinks.BATCH_INDEX, raw.stored_batch_index(spark, sf))
    first.write("indicators", td.indicators(spark, sf))
    first.reserve_ids(entries.agg(F.max("id")).first()[0] or 0)
    first.commit()
    return log


def _load_committed(spark, sf):
    """Submissions loaded into a store: the first attempt stops behind its first tables, the second commits."""
    log = _stored_log(spark, sf, "committed")
    reads = (sinks.ENTRIES, sinks.PRESENCE_TABLE, sinks.BATCH_INDEX, "indicators")

    def ingested(load):
        return ingest.ingest_submissions(raw.submissions(spark, sf), load.read("indicators"), load.read(sinks.ENTRIES),
                                         load.read(sinks.PRESENCE_TABLE), batch_index=load.read(sinks.BATCH_INDEX))

    stopped = log.begin("day-1", reads)
    result = ingested(stopped)
    stopped.write(sinks.PRESENCE_TABLE, result.presence)
    stopped.write(sinks.AUDIT_TABLE, result.audit)
    sinks.run_load(log, "day-1", reads, ingested)
    return log.read(sinks.ENTRIES).select("id", *ENTRY_COLUMNS, "load_id")


def _snapshot_committed(spark, sf):
    """All tables of a store as of one version, in a backup that runs after a later load; files checked."""
    log = _stored_log(spark, sf, "committed")
    version = log.head()
    later = log.begin("later")
    later.write(sinks.PRESENCE_TABLE, raw.stored_presence(spark, sf))
    later.write("indicators", td.indicators(spark, sf), replace=True)
    later.commit()
    base, day = store.scratch_path(spark, "backups"), dt.date.fromisoformat(P.SNAPSHOT_DAY)
    paths = snapshot.write_committed(log, base, day, version)
    damaged = snapshot.verify(spark, base, day).groupBy("table_name").agg(F.count("*").alias("n"))
    counts = None
    for name in sorted(paths):
        one = snapshot.read_snapshot(spark, base, day, name).agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts.join(damaged, "table_name", "left").select(
        "table_name", "n_rows", F.coalesce("n", F.lit(0).cast("long")).alias("damaged_files"))


def _summary_rollup(spark, sf):
    """R1 from the roll-ups of two loads, one of them rewritten (its first version held other answers)."""
    entries = td.kpi_entries(spark, sf)
    stored = F.substring("batch_id", 3, 30).try_cast("long") % raw.STORED_EVERY == 0
    log = CommitLog(spark, store.scratch_path(spark, "rollup"))
    wrong = entries.where(~stored).withColumn("earned_points", F.lit(0).cast("decimal(8,2)"))
    for load_id, rows in (("a", entries.where(stored)), ("b", wrong), ("b", entries.where(~stored))):
        load = log.begin(load_id)
        load.write(rollup.TABLE, rollup.daily_points(rows), ("entry_month",))
        load.commit()
    return rollup.kpi_summary(log.read(rollup.TABLE), td.staff(spark, sf), td.rooms(spark, sf), *_whole_range(entries))


def _exported(spark, sf):
    """K4: the summary as JSON Lines, read back."""
    summary = _summary()(spark, sf)
    path = store.scratch_path(spark, "export")
    sinks.export_json(summary, path)
    return spark.read.schema(summary.schema).json(path)


def _seed_audit(spark, sf):
    return dimensions.audit_row([td.rooms(spark, sf), td.slots(spark, sf), td.staff(spark, sf), td.indicators(spark, sf)])


def queries() -> dict[str, Query]:
    return {
        "kpi_summary": _summary(),
        "kpi_summary_room": _summary(room=P.ROOM),
        "kpi_summary_page": _summary(page=P.PAGE, per_page=P.PER_PAGE),
        "kpi_monthly": _monthly(),
        "kpi_monthly_room": _monthly(room=P.ADMIN_ROOM),
        "top_violations": _violations(),
        "top_violations_room": _violations(room=P.ROOM),
        "daily_report": _daily,
        "kpi_bands": _bands,
        "daily_view": lambda s, sf: reports.daily_view(_daily(s, sf)),
        "active_rooms": lambda s, sf: config.active_rooms(td.rooms(s, sf)),
        "active_slots": lambda s, sf: config.active_slots(td.slots(s, sf)),
        "active_staff": lambda s, sf: config.active_staff(td.staff(s, sf)),
        "active_indicators": lambda s, sf: config.active_indicators(td.indicators(s, sf)),
        "ingest_entries": lambda s, sf: _ingest(s, sf).entries,
        "ingest_presence": lambda s, sf: _ingest(s, sf).presence,
        "ingest_audit": lambda s, sf: _ingest(s, sf).audit,
        "ingest_rejects": lambda s, sf: _ingest(s, sf).rejects,
        "batch_exists": _batch_exists,
        "import_history": lambda s, sf: _history(s, sf).entries,
        "import_history_stats": lambda s, sf: _history(s, sf).stats,
        "import_history_presence": lambda s, sf: _history(s, sf).presence,
        "import_history_rejects": lambda s, sf: _history(s, sf).rejects,
        "import_csv": lambda s, sf: _csv(s, sf).entries,
        "import_csv_stats": lambda s, sf: _csv(s, sf).stats,
        "import_csv_presence": lambda s, sf: _csv(s, sf).presence,
        "import_csv_rejects": lambda s, sf: _csv(s, sf).rejects,
        "kpi_summary_collated": _collated,
        "kpi_monthly_collated": _monthly_collated,
        "checklist": lambda s, sf: config.checklist(td.indicators(s, sf), P.ROOM, P.SLOT, P.SCOPE),
        "checklist_contexts": _checklist_contexts,
        "staff_by_room": lambda s, sf: config.staff_by_room(td.staff(s, sf), P.ROOM),
        "checklist_completeness": lambda s, sf: quality.checklist_completeness(
            td.kpi_entries(s, sf), td.indicators(s, sf)),
        "load_dimension": _load_dimension,
        "snapshot_roundtrip": _snapshot,
        "import_csv_file": lambda s, sf: _csv_file(s, sf).entries,
        "import_csv_file_stats": lambda s, sf: _csv_file(s, sf).stats,
        "import_history_array": lambda s, sf: _history_array(s, sf).entries,
        "load_committed": _load_committed,
        "snapshot_committed": _snapshot_committed,
        "kpi_summary_rollup": _summary_rollup,
        "export_summary": _exported,
        "seed_audit": _seed_audit,
    }

"""Independent DuckDB SQL for every registered query (the correctness oracle).

The canonical tables are re-derived from the driver's tables with plain SQL
(``CANON``) and each query is written against them in SQL, so the Spark
DataFrame plans and these strings share no code. Percentages use the same
integer-hundredths rule (``//`` on HUGEINT) as the Spark side.
"""

from __future__ import annotations

from checkwise import params as P

CANON = """
rooms AS (
  SELECT r_name AS room_code, r_name || ' Room' AS room_name,
         CAST(r_regionkey = 4 AS INTEGER) AS is_admin,
         CAST(r_regionkey <> 3 AS INTEGER) AS active
  FROM region WHERE r_regionkey <> 2),
staff AS (
  SELECT 'st_' || CAST(s_suppkey AS VARCHAR) AS staff_id, s_name AS staff_name,
         CASE WHEN s_suppkey % 3 = 0 THEN 'Teacher' END AS role,
         CASE WHEN s_suppkey % 7 = 0 THEN NULL
              WHEN s_suppkey % 2 = 0 THEN r_name
              ELSE r_name || ', ASIA' END AS rooms,
         CAST(s_acctbal >= 0 AS INTEGER) AS active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey
  WHERE s_suppkey % 13 <> 0),
slots AS (
  SELECT o_orderpriority AS slot_code, 'Slot ' || o_orderpriority AS slot_label,
         substr(o_orderpriority, 1, 1) AS slot_short,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS sort_order,
         CAST(o_orderpriority <> '4-NOT SPECIFIED' AS INTEGER) AS active
  FROM (SELECT DISTINCT o_orderpriority FROM orders) d),
indicators AS (
  SELECT p_partkey + 1 AS id,
         CASE WHEN p_partkey % 4 = 0 THEN '*' ELSE r_name END AS room_code,
         CASE WHEN p_partkey % 3 = 0 THEN '*'
              ELSE CASE p_partkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH'
                   WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END
         END AS slot_code,
         CASE WHEN p_size % 5 = 0 THEN 'Individual' ELSE 'Team' END AS scope,
         p_type AS category, p_name || ' ' || p_brand AS indicator_text,
         CAST(p_size % 7 + 1 AS DECIMAL(5,2)) AS weight,
         CAST(p_size AS INTEGER) AS sort_order,
         CAST(p_partkey % 50 <> 0 AS INTEGER) AS active
  FROM part LEFT JOIN region ON r_regionkey = p_partkey % 5),
kpi_entries AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         'B-' || CAST(l_orderkey AS VARCHAR) AS batch_id,
         CAST(o_orderdate AS DATE) AS entry_date,
         r_name AS room_code, o_orderpriority AS slot_code,
         'st_' || CAST(l_suppkey AS VARCHAR) AS staff_id,
         i.scope, i.id AS indicator_id, i.indicator_text, i.category,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS check_value,
         i.weight,
         CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE i.weight END AS DECIMAL(8,2)) AS earned_points,
         CAST(i.weight AS DECIMAL(8,2)) AS possible_points,
         CASE WHEN l_returnflag = 'R' THEN 'late' END AS comment,
         'clerk_' || CAST(o_custkey % 10 AS VARCHAR) AS submitted_by,
         o_orderdate AS created_at
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN indicators i ON i.id = l_partkey + 1)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join((CANON,) + ctes) + "\n"


def _points(where: str, batches: bool = False) -> str:
    extra = ", COUNT(DISTINCT batch_id) AS total_batches" if batches else ""
    return f"""pts AS (
  SELECT staff_id, room_code,
    SUM(CASE WHEN scope = 'Team' THEN CAST(earned_points * 100 AS BIGINT) ELSE 0 END) AS te,
    SUM(CASE WHEN scope = 'Team' THEN CAST(possible_points * 100 AS BIGINT) ELSE 0 END) AS tp,
    SUM(CASE WHEN scope = 'Individual' THEN CAST(earned_points * 100 AS BIGINT) ELSE 0 END) AS ie,
    SUM(CASE WHEN scope = 'Individual' THEN CAST(possible_points * 100 AS BIGINT) ELSE 0 END) AS ip
    {extra}
  FROM kpi_entries WHERE {where}
  GROUP BY staff_id, room_code),
k AS (
  SELECT p.*, st.staff_name, r.is_admin,
    CASE WHEN tp > 0 THEN sign(te) * ((abs(CAST(te AS HUGEINT)) * 20000 + tp) // (2 * tp)) ELSE 0 END AS t,
    CASE WHEN ip > 0 THEN sign(ie) * ((abs(CAST(ie AS HUGEINT)) * 20000 + ip) // (2 * ip)) ELSE 0 END AS i
  FROM pts p LEFT JOIN staff st ON st.staff_id = p.staff_id
             LEFT JOIN rooms r ON r.room_code = p.room_code),
kk AS (
  SELECT *, CASE WHEN coalesce(is_admin, 0) = 1 OR ip = 0 THEN t
                 ELSE sign(8 * t + 2 * i) * ((abs(8 * t + 2 * i) + 5) // 10) END AS tot
  FROM k)"""


_KPI_COLS = """staff_id, staff_name, room_code, is_admin, {batches}
  CAST(t AS DOUBLE) / 100.0 AS team_kpi, CAST(i AS DOUBLE) / 100.0 AS ind_kpi,
  CAST(tot AS DOUBLE) / 100.0 AS total_kpi"""


def _range(d0: str | None, d1: str | None, room: str | None = None) -> str:
    w = f"entry_date BETWEEN DATE '{d0}' AND DATE '{d1}'" if d0 else "entry_date IS NOT NULL"
    if room:
        w += f" AND room_code = '{room}'"
    return w


def summary_sql(d0: str, d1: str, room: str | None = None, page=None, per_page=None) -> str:
    sql = _with(_points(_range(d0, d1, room))) + \
        f"SELECT {_KPI_COLS.format(batches='')} FROM kk " \
        "ORDER BY room_code NULLS FIRST, staff_name NULLS FIRST, staff_id NULLS FIRST"
    if page is not None:
        sql += f" LIMIT {per_page} OFFSET {(page - 1) * per_page}"
    return sql


def monthly_sql(d0: str, d1: str, room: str | None = None) -> str:
    return _with(_points(_range(d0, d1, room), batches=True)) + \
        f"SELECT {_KPI_COLS.format(batches='total_batches,')} FROM kk " \
        "ORDER BY room_code NULLS FIRST, staff_name NULLS FIRST, staff_id NULLS FIRST"


def violations_sql(d0: str, d1: str, room: str | None = None, limit: int = 20) -> str:
    return _with() + f"""SELECT indicator_text, category, scope, COUNT(*) AS violation_count
FROM kpi_entries WHERE {_range(d0, d1, room)} AND check_value = 0
GROUP BY indicator_text, category, scope
ORDER BY violation_count DESC, indicator_text NULLS FIRST, category NULLS FIRST,
         CASE scope WHEN 'Team' THEN 1 WHEN 'Individual' THEN 2 ELSE 3 END
LIMIT {limit}"""


def daily_sql(day: str, room: str) -> str:
    return _with() + f"""SELECT e.id, e.batch_id, e.slot_code, e.staff_id, st.staff_name, e.scope,
  e.indicator_text, e.category, e.check_value, e.weight, e.earned_points, e.possible_points,
  e.comment, e.submitted_by, e.created_at
FROM kpi_entries e LEFT JOIN staff st ON st.staff_id = e.staff_id
WHERE e.entry_date = DATE '{day}' AND e.room_code = '{room}'
ORDER BY e.slot_code, CASE e.scope WHEN 'Team' THEN 1 WHEN 'Individual' THEN 2 ELSE 3 END,
         st.staff_name NULLS FIRST, e.id"""


def bands_sql(d0: str, d1: str) -> str:
    band = ("CASE WHEN {c} IS NULL OR isnan({c}) THEN 'kpi-bad' WHEN {c} >= 90 THEN 'kpi-good' "
            "WHEN {c} >= 70 THEN 'kpi-warn' ELSE 'kpi-bad' END")
    return f"""WITH s AS ({summary_sql(d0, d1)})
SELECT staff_id, room_code, coalesce(staff_name, staff_id) AS display_name,
  team_kpi, ind_kpi, total_kpi,
  {band.format(c='team_kpi')} AS team_band,
  {band.format(c='ind_kpi')} AS ind_band,
  {band.format(c='total_kpi')} AS total_band
FROM s"""


ACTIVE = {
    "active_rooms": "SELECT room_code, room_name, is_admin FROM rooms WHERE active = 1 ORDER BY room_code",
    "active_slots": "SELECT slot_code, slot_label, slot_short, sort_order FROM slots WHERE active = 1 "
                    "ORDER BY sort_order",
    "active_staff": "SELECT staff_id, staff_name, role, rooms FROM staff WHERE active = 1 "
                    "ORDER BY staff_name, staff_id",
    "active_indicators": "SELECT id, room_code, slot_code, scope, category, indicator_text, "
                         "CAST(weight AS DOUBLE) AS weight, sort_order FROM indicators WHERE active = 1 "
                         "ORDER BY CASE scope WHEN 'Team' THEN 1 ELSE 2 END, sort_order, id",
}


def oracle_sql() -> dict[str, str]:
    q = {
        "kpi_summary": summary_sql(None, None),
        "kpi_summary_room": summary_sql(None, None, P.ROOM),
        "kpi_summary_page": summary_sql(None, None, None, P.PAGE, P.PER_PAGE),
        "kpi_monthly": monthly_sql(*P.month_bounds(P.YEAR, P.MONTH)),
        "kpi_monthly_room": monthly_sql(*P.month_bounds(P.YEAR, P.MONTH), P.ADMIN_ROOM),
        "top_violations": violations_sql(None, None, None, P.LIMIT),
        "top_violations_room": violations_sql(None, None, P.ROOM, P.LIMIT),
        "daily_report": daily_sql(P.DAY_ISO, P.ROOM),
        "kpi_bands": bands_sql(None, None),
        "daily_view": f"""WITH d AS ({daily_sql(P.DAY_ISO, P.ROOM)})
SELECT id, slot_code, coalesce(staff_name, staff_id) AS display_name, scope, indicator_text,
  CASE WHEN check_value = 1 THEN 'Yes' ELSE 'No' END AS check_label, weight,
  coalesce(comment, '') AS comment FROM d""",
    }
    for name, body in ACTIVE.items():
        q[name] = _with() + body
    q.update(ingest_sql())
    q.update(imports_sql())
    q.update(more_sql())
    return q


# --- ingest (I1, I2) ----------------------------------------------------------

_INGEST_CTES = """ctx AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, r_name
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey),
li AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, i.scope AS iscope,
         CASE WHEN l_returnflag = 'R' THEN 'no' WHEN l_returnflag = 'A' THEN 'yes'
              WHEN l_linenumber % 2 = 1 THEN 'yes' END AS chk,
         CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE ' late ' END AS cmt
  FROM lineitem l JOIN indicators i ON i.id = l.l_partkey + 1),
items AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, iscope, chk, cmt, 0 AS dup FROM li
  UNION ALL
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, iscope,
         CASE WHEN chk = 'yes' THEN 'no' ELSE 'yes' END, cmt, 1 FROM li WHERE l_linenumber = 1),
present AS (SELECT DISTINCT l_orderkey, l_suppkey AS p_supp FROM lineitem),
valid AS (SELECT * FROM ctx WHERE o_orderkey % 97 <> 0
          AND o_orderkey IN (SELECT l_orderkey FROM lineitem)),
cand AS (
  SELECT it.*, 'st_' || CAST(p.p_supp AS VARCHAR) AS staff_id, 'Team' AS scope, 1 AS sord
  FROM items it JOIN present p ON p.l_orderkey = it.l_orderkey WHERE it.iscope = 'Team'
  UNION ALL
  SELECT it.*, 'st_' || CAST(it.l_suppkey AS VARCHAR), 'Individual', 2
  FROM items it WHERE it.iscope = 'Individual'),
looked AS (
  SELECT c.*, v.o_orderdate, v.o_orderpriority, v.r_name, v.o_custkey,
         ind.indicator_text, ind.category, ind.weight
  FROM cand c JOIN valid v ON v.o_orderkey = c.l_orderkey
  JOIN indicators ind ON ind.id = c.l_partkey + 1 AND ind.active = 1
       AND (ind.room_code = v.r_name OR ind.room_code = '*')
       AND (ind.slot_code = v.o_orderpriority OR ind.slot_code = '*')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, staff_id, l_partkey
                               ORDER BY sord, dup, l_linenumber, l_partkey, l_suppkey) AS rn
  FROM looked),
stored AS (SELECT batch_id, staff_id, indicator_id FROM kpi_entries WHERE CAST(substr(batch_id, 3) AS BIGINT) % 10 = 0),
new_entries AS (
  SELECT 'B-' || CAST(l_orderkey AS VARCHAR) AS batch_id, CAST(o_orderdate AS DATE) AS entry_date,
         r_name AS room_code, o_orderpriority AS slot_code, staff_id, scope,
         l_partkey + 1 AS indicator_id, indicator_text, category,
         CASE WHEN chk = 'yes' THEN 1 ELSE 0 END AS check_value, weight,
         CAST(CASE WHEN chk = 'yes' THEN weight ELSE 0 END AS DECIMAL(8,2)) AS earned_points,
         CAST(weight AS DECIMAL(8,2)) AS possible_points,
         CASE WHEN trim(cmt) IN ('', '0') THEN NULL ELSE trim(cmt) END AS comment,
         'mgr_' || CAST(o_custkey % 5 AS VARCHAR) AS submitted_by, l_orderkey
  FROM ranked r
  WHERE rn = 1 AND NOT EXISTS (
    SELECT 1 FROM stored s WHERE s.batch_id = 'B-' || CAST(r.l_orderkey AS VARCHAR)
      AND s.staff_id = r.staff_id AND s.indicator_id = r.l_partkey + 1))"""

_ENTRY_COLS = ("batch_id, entry_date, room_code, slot_code, staff_id, scope, indicator_id, "
               "indicator_text, category, check_value, weight, earned_points, possible_points, "
               "comment, submitted_by")


def ingest_sql() -> dict[str, str]:
    w = _with(_INGEST_CTES)
    return {
        "ingest_entries": w + f"SELECT {_ENTRY_COLS} FROM new_entries",
        "ingest_presence": w + """SELECT DISTINCT 'B-' || CAST(v.o_orderkey AS VARCHAR) AS batch_id,
  'st_' || CAST(p.p_supp AS VARCHAR) AS staff_id
FROM valid v JOIN present p ON p.l_orderkey = v.o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.batch_id = 'B-' || CAST(v.o_orderkey AS VARCHAR)
                  AND s.staff_id = 'st_' || CAST(p.p_supp AS VARCHAR))""",
        "ingest_audit": w + """SELECT 'mgr_' || CAST(v.o_custkey % 5 AS VARCHAR) AS "user",
  'saveBatch' AS action, 'B-' || CAST(v.o_orderkey AS VARCHAR) AS batch_id,
  '10.0.0.' || CAST(v.o_custkey % 250 AS VARCHAR) AS ip,
  (SELECT COUNT(*) FROM new_entries n WHERE n.l_orderkey = v.o_orderkey) AS rows_saved,
  CAST(NULL AS VARCHAR) AS note
FROM valid v""",
        "ingest_rejects": w + """SELECT o_orderkey AS seq, 'B-' || CAST(o_orderkey AS VARCHAR) AS batch_id,
  'Invalid date format: bad' AS reason
FROM ctx WHERE o_orderkey % 97 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
        "batch_exists": _with("""stored_batches AS (
  SELECT DISTINCT batch_id FROM kpi_entries WHERE CAST(substr(batch_id, 3) AS BIGINT) % 10 = 0)""") +
        """SELECT DISTINCT 'B-' || CAST(o_orderkey AS VARCHAR) AS batch_id,
  CASE WHEN 'B-' || CAST(o_orderkey AS VARCHAR) IN (SELECT batch_id FROM stored_batches)
       THEN 1 ELSE 0 END AS "exists"
FROM orders""",
    }


# --- imports (I3, I4) ---------------------------------------------------------

_IMPORT_CTES = """ctx AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, r_name
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey),
lx AS (
  SELECT l.l_orderkey AS o, l.l_partkey AS pk, l.l_suppkey AS sk, l.l_linenumber AS ln,
         CAST(l.l_quantity AS BIGINT) % 3 AS q, l.l_returnflag AS flag,
         i.scope AS iscope, i.indicator_text, i.category, CAST(i.weight AS INTEGER) AS w,
         c.o_orderdate, c.o_orderpriority, c.r_name
  FROM lineitem l JOIN indicators i ON i.id = l.l_partkey + 1
                  JOIN ctx c ON c.o_orderkey = l.l_orderkey),
stored_presence AS (
  SELECT DISTINCT batch_id, staff_id FROM kpi_entries WHERE CAST(substr(batch_id, 3) AS BIGINT) % 10 = 0),
hj AS (
  SELECT *, '{' || concat_ws(',',
      CASE WHEN ln <> 7 AND ln % 2 = 1 THEN '"batch_id":"B-' || CAST(o AS VARCHAR) || '"'
           WHEN ln <> 7 AND ln % 2 = 0 THEN '"batchId":"H-' || CAST(o AS VARCHAR) || '"' END,
      CASE WHEN pk % 2 = 0 THEN '"date":"' || dtext || '"' END,
      CASE WHEN pk % 2 = 1 THEN '"entry_date":"' || dtext || '"' END,
      CASE WHEN o % 2 = 0 THEN '"room":"' || r_name || '"' ELSE '"room_code":"' || r_name || '"' END,
      CASE WHEN sk % 2 = 0 THEN '"slot":"' || o_orderpriority || '"'
           ELSE '"slot_code":"' || o_orderpriority || '"' END,
      CASE WHEN ln % 2 = 1 THEN '"staff_id":"st_' ELSE '"staffId":"st_' END || CAST(sk AS VARCHAR) || '"',
      CASE WHEN pk % 13 <> 0 THEN '"scope":"' ||
           CASE WHEN pk % 97 = 0 THEN 'Group' WHEN pk % 89 = 0 THEN lower(iscope) ELSE iscope END || '"' END,
      CASE WHEN pk % 5 <> 0 THEN '"indicator":"' ELSE '"indicator_text":"' END || indicator_text || '"',
      CASE WHEN pk % 7 <> 0 THEN '"category":"' || category || '"' END,
      '"check":' || CASE WHEN flag = 'R' THEN '"no"' WHEN flag = 'A' THEN '"yes"'
                         WHEN pk % 3 = 0 THEN '1' WHEN pk % 3 = 1 THEN '"1"' ELSE 'true' END,
      CASE WHEN pk % 11 <> 0 THEN '"weight":' || CAST(w AS VARCHAR) END,
      CASE WHEN q = 1 THEN '"comment":"0"' WHEN q = 2 THEN '"comment":" late "' END) || '}' AS jtext
  FROM (SELECT *, CASE o % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y')
                             WHEN 1 THEN strftime(o_orderdate, '%m-%d-%Y')
                             WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS dtext
        FROM lx) h),
hist AS (
  SELECT CASE WHEN ln = 7 THEN 'MIGR-' || md5(replace(jtext, '/', '\\/'))
              WHEN ln % 2 = 1 THEN 'B-' || CAST(o AS VARCHAR) ELSE 'H-' || CAST(o AS VARCHAR) END AS batch_id,
         CAST(o_orderdate AS DATE) AS entry_date, r_name AS room_code, o_orderpriority AS slot_code,
         'st_' || CAST(sk AS VARCHAR) AS staff_id,
         CASE WHEN pk % 13 = 0 THEN 'Team' ELSE iscope END AS scope,
         CAST(NULL AS BIGINT) AS indicator_id, indicator_text,
         CASE WHEN pk % 7 = 0 THEN 'Imported' ELSE category END AS category,
         CASE WHEN flag = 'A' OR (flag = 'N' AND pk % 3 = 0) THEN 1 ELSE 0 END AS check_value,
         CAST(CASE WHEN pk % 11 = 0 THEN 1 ELSE w END AS DECIMAL(5,2)) AS weight,
         CASE WHEN q = 2 THEN ' late ' END AS comment, 'migrate_v2' AS submitted_by, o, pk, jtext
  FROM hj),
cy AS (
  SELECT *, 1 + k + (k - 1) // 100 AS line_no, CAST(o_orderdate AS DATE) + 10000 AS d2
  FROM (SELECT *, row_number() OVER (ORDER BY o, ln, pk, sk) AS k FROM lx) cx),
csvr AS (
  SELECT 'XLS-' || md5(strftime(d2, '%Y-%m-%d') || r_name || o_orderpriority) AS batch_id,
         d2 AS entry_date, r_name AS room_code, o_orderpriority AS slot_code,
         CASE WHEN sk % 11 = 0
              THEN 'imported_' || md5(r_name || strftime(d2, '%Y-%m-%d') || CAST(line_no AS VARCHAR))
              ELSE 'st_' || CAST(sk AS VARCHAR) END AS staff_id,
         iscope AS scope, CAST(NULL AS BIGINT) AS indicator_id, indicator_text, category,
         CASE WHEN flag = 'R' THEN 0 ELSE 1 END AS check_value,
         CAST(w AS DECIMAL(5,2)) AS weight, CAST(NULL AS VARCHAR) AS comment,
         'migrate_excel' AS submitted_by, o, pk, line_no
  FROM cy)"""

_IMPORT_COLS = ("batch_id, entry_date, room_code, slot_code, staff_id, scope, indicator_id, "
                "indicator_text, category, check_value, weight, "
                "CAST(CASE WHEN check_value = 1 THEN weight ELSE 0 END AS DECIMAL(8,2)) AS earned_points, "
                "CAST(weight AS DECIMAL(8,2)) AS possible_points, comment, submitted_by")


def imports_sql() -> dict[str, str]:
    w = _with(_IMPORT_CTES)
    hist_read = "o % 4 <> 3"
    hist_bad = "pk % 13 <> 0 AND pk % 97 = 0"
    hist_ok = f"{hist_read} AND NOT ({hist_bad})"
    csv_read = "o % 5 <> 4 AND pk % 17 <> 0"
    csv_bad = "pk % 79 = 0"
    csv_ok = f"{csv_read} AND NOT ({csv_bad})"
    return {
        "import_history": w + f"SELECT {_IMPORT_COLS} FROM hist WHERE {hist_ok}",
        "import_history_stats": w + f"""SELECT COUNT(*) FILTER (WHERE {hist_ok}) AS imported,
  COUNT(*) FILTER (WHERE NOT ({hist_read})) AS skipped,
  COUNT(*) FILTER (WHERE {hist_read} AND {hist_bad}) AS rejected FROM hist""",
        "import_history_rejects": w + f"""SELECT jtext AS source_ref, batch_id, 'Invalid scope: Group' AS reason
FROM hist WHERE {hist_read} AND {hist_bad}""",
        "import_history_presence": w + f"""SELECT DISTINCT batch_id, staff_id FROM hist h
WHERE {hist_ok} AND NOT EXISTS (SELECT 1 FROM stored_presence s
                                WHERE s.batch_id = h.batch_id AND s.staff_id = h.staff_id)""",
        "import_csv": w + f"SELECT {_IMPORT_COLS} FROM csvr WHERE {csv_ok}",
        "import_csv_stats": w + f"""SELECT COUNT(*) FILTER (WHERE {csv_ok}) AS imported,
  COUNT(*) FILTER (WHERE NOT ({csv_read})) AS skipped,
  COUNT(*) FILTER (WHERE {csv_read} AND {csv_bad}) AS rejected FROM csvr""",
        "import_csv_rejects": w + f"""SELECT line_no AS source_ref, batch_id, 'Weight out of range' AS reason
FROM csvr WHERE {csv_read} AND {csv_bad}""",
        "import_csv_presence": w + f"""SELECT DISTINCT batch_id, staff_id FROM csvr c
WHERE {csv_ok} AND NOT EXISTS (SELECT 1 FROM stored_presence s
                               WHERE s.batch_id = c.batch_id AND s.staff_id = c.staff_id)""",
    }


def files_sql() -> dict[str, str]:
    """The file readers: a CSV record's number in its file, line breaks and quotes inside cells, history arrays."""
    row = "((line_no - 2) % 100000 + 2)"
    text = """CASE WHEN line_no % 4 = 0 THEN replace(indicator_text, ' Brand', chr(10) || '"Brand"') ELSE indicator_text END"""
    csvf = f"""csvf AS (
  SELECT * REPLACE ({text} AS indicator_text,
    CASE WHEN staff_id LIKE 'imported_%' THEN 'imported_' || md5(room_code || strftime(entry_date, '%Y-%m-%d')
         || CAST({row} AS VARCHAR)) ELSE staff_id END AS staff_id) FROM csvr)"""
    all_imports = imports_sql()
    w = _with(_IMPORT_CTES, csvf)
    return {
        "import_csv_file": w + f"SELECT {_IMPORT_COLS} FROM csvf WHERE o % 5 <> 4 AND pk % 17 <> 0 AND pk % 79 <> 0",
        "import_csv_file_stats": all_imports["import_csv_stats"],
        "import_history_array": all_imports["import_history"],
    }


# --- collation, checklist, completeness, dimension load, snapshot --------------

_ENTRY_ALL = ("id, batch_id, entry_date, room_code, slot_code, staff_id, scope, indicator_id, "
              "indicator_text, category, check_value, weight, earned_points, possible_points, "
              "comment, submitted_by, created_at")


def more_sql() -> dict[str, str]:
    collated = f"""WITH s AS ({summary_sql(None, None)})
SELECT staff_id, staff_name, lower(room_code) AS room_code, is_admin, team_kpi, ind_kpi, total_kpi FROM s"""
    ind_cols = ("i.id, i.room_code, i.slot_code, i.scope, i.category, i.indicator_text, "
                "CAST(i.weight AS DOUBLE) AS weight, i.sort_order")
    monthly_collated = f"""WITH m AS ({monthly_sql(*P.month_bounds(P.YEAR, P.MONTH))})
SELECT staff_id, staff_name, lower(room_code) AS room_code, is_admin, total_batches,
  team_kpi, ind_kpi, total_kpi FROM m"""
    return {
        "kpi_summary_collated": collated,
        "kpi_monthly_collated": monthly_collated,
        "checklist": _with() + f"""SELECT {ind_cols} FROM indicators i
WHERE i.active = 1 AND i.scope = '{P.SCOPE}'
  AND (i.room_code = '{P.ROOM}' OR i.room_code = '*') AND (i.slot_code = '{P.SLOT}' OR i.slot_code = '*')
ORDER BY i.sort_order, i.id""",
        "checklist_contexts": _with() + """SELECT c.room_code, c.slot_code, i.id AS indicator_id, i.scope,
  i.category, i.indicator_text, CAST(i.weight AS DOUBLE) AS weight, i.sort_order
FROM (SELECT DISTINCT room_code, slot_code FROM kpi_entries) c
JOIN indicators i ON i.active = 1 AND (i.room_code = c.room_code OR i.room_code = '*')
                 AND (i.slot_code = c.slot_code OR i.slot_code = '*')""",
        "staff_by_room": _with() + f"""SELECT staff_id, staff_name, role, rooms FROM staff
WHERE active = 1 AND (rooms IS NULL OR rooms = ''
  OR list_contains(list_transform(string_split(rooms, ','), lambda x: trim(x)), '{P.ROOM}'))
ORDER BY staff_name, staff_id""",
        "checklist_completeness": _with("""b AS (SELECT DISTINCT batch_id, room_code, slot_code FROM kpi_entries),
ind AS (SELECT id, room_code, slot_code FROM indicators WHERE active = 1 AND scope = 'Team'),
ex AS (
  SELECT b.batch_id, b.room_code, b.slot_code, COUNT(i.id) AS expected_items
  FROM b LEFT JOIN ind i ON (i.room_code = b.room_code OR i.room_code = '*')
                        AND (i.slot_code = b.slot_code OR i.slot_code = '*')
  GROUP BY b.batch_id, b.room_code, b.slot_code),
ans AS (
  SELECT e.batch_id, e.room_code, e.slot_code, COUNT(DISTINCT i.id) AS answered_items
  FROM kpi_entries e JOIN ind i ON i.id = e.indicator_id AND e.scope = 'Team'
       AND (i.room_code = e.room_code OR i.room_code = '*')
       AND (i.slot_code = e.slot_code OR i.slot_code = '*')
  GROUP BY e.batch_id, e.room_code, e.slot_code)""") + """SELECT ex.batch_id, ex.room_code, ex.slot_code, ex.expected_items,
  coalesce(ans.answered_items, 0) AS answered_items,
  ex.expected_items - coalesce(ans.answered_items, 0) AS unanswered_items
FROM ex LEFT JOIN ans ON ans.batch_id = ex.batch_id AND ans.room_code = ex.room_code
                     AND ans.slot_code = ex.slot_code""",
        "load_dimension": _with("""incoming AS (
  SELECT 'st_' || CAST(s_suppkey AS VARCHAR) AS staff_id, 'NEW ' || s_name AS staff_name, s_suppkey * 2 AS seq
  FROM supplier
  UNION ALL
  SELECT 'st_' || CAST(s_suppkey AS VARCHAR), 'DUP ' || s_name, s_suppkey * 2 + 1
  FROM supplier),
firsts AS (
  SELECT staff_id, staff_name FROM (
    SELECT *, row_number() OVER (PARTITION BY staff_id ORDER BY seq) AS rn FROM incoming) x
  WHERE rn = 1)""") + """SELECT staff_id, staff_name, role, rooms, active FROM staff
UNION ALL
SELECT staff_id, staff_name, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 1 FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM staff s WHERE s.staff_id = f.staff_id)""",
        "snapshot_roundtrip": _with() + f"SELECT {_ENTRY_ALL} FROM kpi_entries",
        **files_sql(),
        "load_committed": _with(_INGEST_CTES) + f"""SELECT id, {_ENTRY_COLS}, 'stored' AS load_id FROM kpi_entries
WHERE CAST(substr(batch_id, 3) AS BIGINT) % 10 = 0
UNION ALL
SELECT (SELECT max(id) FROM kpi_entries WHERE CAST(substr(batch_id, 3) AS BIGINT) % 10 = 0)
       + row_number() OVER (ORDER BY batch_id, staff_id, indicator_id) AS id, {_ENTRY_COLS}, 'day-1' FROM new_entries""",
        "snapshot_committed": _with("""old AS (SELECT * FROM kpi_entries WHERE CAST(substr(batch_id, 3) AS BIGINT) % 10 = 0)""") +
        """SELECT 'kpi_entries' AS table_name, COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS damaged_files FROM old
UNION ALL SELECT 'kpi_batch_presence', COUNT(*), 0 FROM (SELECT DISTINCT batch_id, staff_id FROM old)
UNION ALL SELECT 'batch_index', COUNT(*), 0 FROM (SELECT DISTINCT batch_id, date_trunc('month', entry_date) AS m FROM old)
UNION ALL SELECT 'indicators', COUNT(*), 0 FROM indicators""",
        "export_summary": summary_sql(None, None),
        "kpi_summary_rollup": summary_sql(None, None),
        "seed_audit": _with() + """SELECT 'anonymous' AS "user", 'seed_config' AS action, '' AS batch_id, '' AS ip,
  (SELECT COUNT(*) FROM rooms) + (SELECT COUNT(*) FROM slots) + (SELECT COUNT(*) FROM staff)
  + (SELECT COUNT(*) FROM indicators) AS rows_saved, CAST(NULL AS VARCHAR) AS note""",
    }

"""Date grammars. Each input path has its own (they differ on purpose):

* F1 ``submission_date`` — ``MM-DD-YYYY`` or ISO ``YYYY-MM-DD``, else invalid.
* F2 ``history_date``    — trimmed; ``MM/DD/YYYY`` or ``MM-DD-YYYY`` (two-digit
  parts, separators may mix) or ISO, else '' (the record is skipped).
* F3 ``csv_date``        — trimmed; 1–2 digit month/day with ``/`` or ``-``, ISO,
  or a spreadsheet serial number whose integer part is above 40000.

Every grammar checks shape only; a shape match that is not a real calendar day
(``13/45/2026``) is *invalid* and goes to the rejects, never silently coerced.
All parsing uses ``try_to_date`` so bad input cannot fail a job under ANSI mode.
Each Column helper returns a struct ``(shape_ok, value)``: ``shape_ok`` false
means "no date given" for that grammar, ``value`` NULL with ``shape_ok`` true
means "given but not a real date".
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the three grammars and the serial-date rule.
SUBMISSION_US = r"^(\d{2})-(\d{2})-(\d{4})$"
ISO = r"^\d{4}-\d{2}-\d{2}$"
HISTORY_US = r"^(\d{2})[/-](\d{2})[/-](\d{4})$"
CSV_US = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SERIAL_FLOOR = 40000        # integer part must be greater than this
SERIAL_EPOCH_OFFSET = 25569  # serial of 1970-01-01
SERIAL_MAX = 2958465         # serial of 9999-12-31

# Fixed value: the characters a PHP-style trim() strips (space, tab, LF, CR,
# NUL, VT).
TRIM_CHARS = " \t\n\r\x00\x0b"


def php_trim(c: Column) -> Column:
    """trim() over the same character set the reference strips."""
    return F.btrim(c, F.lit(TRIM_CHARS))


def _iso(s: Column) -> Column:
    return F.try_to_date(s, "yyyy-MM-dd")


def _ymd(y: Column, m: Column, d: Column) -> Column:
    txt = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return _iso(txt)


def _result(shape_ok: Column, value: Column) -> Column:
    return F.struct(shape_ok.alias("shape_ok"), value.alias("value"))


def submission_date(raw: Column) -> Column:
    """MM-DD-YYYY (form format) or ISO; anything else is invalid."""
    us = raw.rlike(SUBMISSION_US)
    iso = raw.rlike(ISO)
    value = (F.when(us, _ymd(F.regexp_extract(raw, SUBMISSION_US, 3),
                             F.regexp_extract(raw, SUBMISSION_US, 1),
                             F.regexp_extract(raw, SUBMISSION_US, 2)))
             .when(iso, _iso(raw)))
    return _result(F.coalesce(us | iso, F.lit(False)), value)


def history_date(raw: Column, trimmed: bool = False) -> Column:
    """trimmed MM/DD/YYYY, MM-DD-YYYY (mixed separators) or ISO."""
    s = raw if trimmed else php_trim(raw)
    us = s.rlike(HISTORY_US)
    iso = s.rlike(ISO)
    value = (F.when(us, _ymd(F.regexp_extract(s, HISTORY_US, 3),
                             F.regexp_extract(s, HISTORY_US, 1),
                             F.regexp_extract(s, HISTORY_US, 2)))
             .when(iso, _iso(s)))
    return _result(F.coalesce(us | iso, F.lit(False)), value)


def csv_date(raw: Column, trimmed: bool = False) -> Column:
    """trimmed M/D/YYYY (1–2 digit parts), ISO, or serial number > 40000
    (fraction truncated; day 0 of the serial scale is 1899-12-30)."""
    s = raw if trimmed else php_trim(raw)
    us = s.rlike(CSV_US)
    iso = s.rlike(ISO)
    num = s.rlike(NUMERIC)
    serial = s.try_cast("double")
    serial_int = F.when(F.abs(serial) < 1e15, F.floor(serial).cast("long"))
    is_serial = num & (serial_int > SERIAL_FLOOR)
    in_range = serial_int <= SERIAL_MAX
    serial_day = F.when(in_range, F.date_add(F.lit(dt.date(1970, 1, 1)),
                                             (serial_int - SERIAL_EPOCH_OFFSET).cast("int")))
    value = (F.when(us, _ymd(F.regexp_extract(s, CSV_US, 3),
                             F.regexp_extract(s, CSV_US, 1),
                             F.regexp_extract(s, CSV_US, 2)))
             .when(iso, _iso(s))
             .when(is_serial, serial_day))
    return _result(F.coalesce(us | iso | is_serial, F.lit(False)), value)


def us_date(d: Column) -> Column:
    """format a date as MM-DD-YYYY."""
    return F.date_format(d, "MM-dd-yyyy")


# --- Python-side parameter handling (report arguments are scalars) ----------

def parse_report_date(value) -> dt.date:
    """F1 for a report parameter: a date, or MM-DD-YYYY / YYYY-MM-DD text."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if value is None:
        raise ValueError("Missing date")
    s = str(value)
    m = re.match(SUBMISSION_US, s)
    try:
        if m:
            return dt.date(int(m.group(3)), int(m.group(1)), int(m.group(2)))
        if re.match(ISO, s):
            return dt.date(int(s[0:4]), int(s[5:7]), int(s[8:10]))
    except ValueError:
        pass
    raise ValueError(f"Invalid date format: {s}")


def default_window(today: dt.date) -> tuple[dt.date, dt.date]:
    """the dashboard's default range, first of the month .. today."""
    return today.replace(day=1), today

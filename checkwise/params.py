"""Parameters of the registered queries (shared by the Spark side and the oracle)."""

from __future__ import annotations

import calendar

ROOM = "AMERICA"
ADMIN_ROOM = "MIDDLE EAST"
PAGE = 2
PER_PAGE = 25
YEAR = 1997
MONTH = 4
LIMIT = 20
DAY_US = "04-15-1997"          # the form's MM-DD-YYYY format
DAY_ISO = "1997-04-15"
SLOT = "1-URGENT"
SCOPE = "Team"
COLLATION = "UNICODE_CI_AI_RTRIM"
SNAPSHOT_DAY = "2001-08-02"


def month_bounds(year: int, month: int) -> tuple[str, str]:
    last = calendar.monthrange(year, month)[1]
    return f"{year:04d}-{month:02d}-01", f"{year:04d}-{month:02d}-{last:02d}"

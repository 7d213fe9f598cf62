"""Scoring expressions: points, percentages, blended total, colour band.

Percentages are computed exactly in integer hundredths, so ties round half away
from zero the same way in every engine (binary floats do not: 23/160*100 is
14.374999... in float but 14.375 exactly, which must give 14.38).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from checkwise.schemas import POINTS

_BIG = "decimal(38,0)"

# Band thresholds (percent) and the Team/Individual blend (tenths).
GOOD_FROM = 90
WARN_FROM = 70
TEAM_TENTHS = 8
IND_TENTHS = 2


def _idiv(a: Column, b: Column) -> Column:
    """Spark's integral division (``a div b``), exact on decimals and longs."""
    return F.call_function("div", a, b)


def hundredths(points: Column) -> Column:
    """decimal(p,2) points -> exact long hundredths."""
    return (points * 100).cast("long")


def scope_order(scope: Column) -> Column:
    """Enum order of scope: Team (1) before Individual (2), anything else last."""
    return F.when(scope == "Team", 1).when(scope == "Individual", 2).otherwise(3)


def earned_points(check: Column, weight: Column) -> Column:
    """earned = weight when the check passed, else 0."""
    return F.when(check == 1, weight).otherwise(F.lit(0)).cast(POINTS)


def percent_hundredths(earned_h: Column, possible_h: Column) -> Column:
    """Percent in integer hundredths: round(e/p*100, 2) half away from zero,
    0 when possible <= 0. Inputs are points in hundredths (long); the
    arithmetic runs in decimal(38,0) so huge groups cannot overflow."""
    e = earned_h.cast(_BIG)
    p = possible_h.cast(_BIG)
    mag = _idiv(F.abs(e) * 20000 + p, p * 2)
    return (F.when(p > 0, F.signum(e).cast("long") * mag.cast("long"))
            .otherwise(F.lit(0).cast("long")))


def total_hundredths(team_h: Column, ind_h: Column, is_admin: Column,
                     ind_possible_h: Column) -> Column:
    """Total KPI in hundredths: Team alone for admin rooms or when there is no
    Individual possible; else round(0.8*Team + 0.2*Ind, 2) of the already
    rounded parts. Unknown room (NULL is_admin) is not admin."""
    x = team_h * TEAM_TENTHS + ind_h * IND_TENTHS
    blended = F.signum(x).cast("long") * _idiv(F.abs(x) + 5, F.lit(10)).cast("long")
    team_only = (F.coalesce(is_admin, F.lit(0)) == 1) | (ind_possible_h == 0)
    return F.when(team_only, team_h).otherwise(blended)


def as_percent(h: Column) -> Column:
    return (h / F.lit(100.0)).cast("double")


def kpi_band(value: Column) -> Column:
    """Colour band: >= 90 good, >= 70 warn, else bad (NULL/NaN -> bad)."""
    v = value.cast("double")
    return (F.when(v.isNull() | F.isnan(v), "kpi-bad")
            .when(v >= GOOD_FROM, "kpi-good")
            .when(v >= WARN_FROM, "kpi-warn")
            .otherwise("kpi-bad"))

"""String helpers with the reference's loose-typing rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from checkwise.functions.dates import php_trim

# A leading decimal number (optional sign, digits, fraction,
# exponent) and a leading integer, as a loose numeric cast reads them.
LEADING_NUMBER = r"^[ \t\n\r\x0B\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)"
LEADING_INT = r"^[ \t\n\r\x0B\f]*([+-]?[0-9]+)"

__all__ = ["php_trim", "falsy_to_null", "trimmed_or_null", "leading_number", "leading_int",
           "too_long", "enum_value"]


def falsy_to_null(c: Column) -> Column:
    """``x ?: null`` for strings: '' and '0' are falsy."""
    return F.when(c.isNull() | (c == "") | (c == "0"), F.lit(None).cast("string")).otherwise(c)


def trimmed_or_null(c: Column) -> Column:
    """``trim(x) ?: null``."""
    return falsy_to_null(php_trim(c))


def leading_number(c: Column, default: float | None = None) -> Column:
    """Loose float cast: '2,5 kg' -> 2.0, 'abc' -> 0.0, NULL -> ``default``."""
    m = F.regexp_extract(c, LEADING_NUMBER, 1)
    v = F.coalesce(F.when(m != "", m).try_cast("double"), F.lit(0.0))
    if default is None:
        return F.when(c.isNotNull(), v)
    return F.when(c.isNotNull(), v).otherwise(F.lit(float(default)))


def leading_int(c: Column) -> Column:
    """Loose int cast: '12abc' -> 12, '5.7' -> 5, 'x' -> 0, NULL -> 0."""
    m = F.regexp_extract(c, LEADING_INT, 1)
    return F.coalesce(F.when(m != "", m).try_cast("long"), F.lit(0).cast("long"))


def too_long(c: Column, limit: int) -> Column:
    return F.coalesce(F.length(c) > limit, F.lit(False))


def enum_value(c: Column, allowed: tuple[str, ...]) -> Column:
    """An ENUM column's stored value: the allowed value equal to ``c`` ignoring
    case and trailing spaces (as the store's collation compares), else NULL."""
    key = F.lower(F.rtrim(c))
    out = F.lit(None).cast("string")
    for v in reversed(allowed):
        out = F.when(key == v.lower(), F.lit(v)).otherwise(out)
    return out

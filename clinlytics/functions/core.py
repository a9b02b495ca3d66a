"""Column-level helpers built only from ``pyspark.sql.functions``.

Everything here is a JVM expression, so it stays inside whole-stage codegen.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_AS_OF = _dt.date(2001, 7, 15)


def as_of_lit(as_of: _dt.date | str | None) -> Column:
    """The reporting day as a DATE literal (replaces NOW()/CURRENT_DATE)."""
    if as_of is None:
        as_of = DEFAULT_AS_OF
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def age_years(dob: Column | str, as_of: Column) -> Column:
    """Whole years between ``dob`` and ``as_of`` by calendar subtraction.

    A 29 February birthday turns a year older on 1 March in common years.
    """
    dob = F.col(dob) if isinstance(dob, str) else dob
    before = (F.month(as_of) < F.month(dob)) | (
        (F.month(as_of) == F.month(dob)) & (F.dayofmonth(as_of) < F.dayofmonth(dob)))
    return (F.year(as_of) - F.year(dob) - F.when(before, 1).otherwise(0)).cast("int")


def sql_age_years(dob: Column | str, as_of: Column) -> Column:
    """Year field of the SQL ``AGE(as_of, dob)`` interval.

    Equal to ``age_years`` for people already born; for a birth date after
    ``as_of`` the interval is negative and its year part truncates toward 0.
    """
    dob = F.col(dob) if isinstance(dob, str) else dob
    return F.when(dob <= as_of, age_years(dob, as_of)).otherwise(-age_years(as_of, dob)).cast("int")


def capitalize(c: Column) -> Column:
    """First character upper case, the rest lower case (str.capitalize)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


# Fixed value: the characters that Unicode counts as white space.
WHITESPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (str.strip)."""
    return F.btrim(c, F.lit(WHITESPACE))


def truthy_text(c: Column) -> Column:
    """Python truthiness of an optional string: not NULL and not empty."""
    return c.isNotNull() & (c != "")


def pct(num: Column, den: Column, scale: int = 2, out_type: str = "decimal(5,2)") -> Column:
    """ROUND(num * 100.0 / NULLIF(den, 0), scale) in exact decimal arithmetic."""
    n = num.cast("decimal(20,0)") * F.lit(100)
    d = F.nullif(den.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.round(n / d, scale).cast(out_type)


def ratio_1dp_half_even(num: Column, den: Column) -> Column:
    """Python ``round(num / den * 100, 1)`` on doubles (half to even); 0 when den is 0."""
    return F.when(den > 0, F.bround(num.cast("double") / den.cast("double") * F.lit(100.0), 1)) \
        .otherwise(F.lit(0.0))


def money(c: Column, precision: int = 12) -> Column:
    return F.coalesce(c, F.lit(0)).cast(f"decimal({precision},2)")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, with '' as NULL (form inputs)."""
    return F.nullif(strip_ws(c), F.lit(""))


def parse_date(c: Column) -> Column:
    """'YYYY-MM-DD' to DATE, NULL when malformed (reject instead of raising)."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))

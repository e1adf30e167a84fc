"""Fuzzy dates: bounds of an EDTF subset as Column expressions.

Read are years, months, days, timestamps (by their day), unspecified digits (198X, 19XX), the marks
~ ? % (a year wider on each side of a year, a month of a month, a day of a day), intervals a/b with
open or unknown sides, and ascending ``YYYY-YYYY``. Bounds are half open; a blank or unreadable text
has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_YEAR, _MONTH, _DAY = r"^\d{4}[~?%]?$", r"^\d{4}-\d{2}[~?%]?$", r"^\d{4}-\d{2}-\d{2}(T.*)?[~?%]?$"
_DECADE, _CENTURY = r"^\d{3}[Xx]$", r"^\d{2}[Xx]{2}$"


def normalised(text: Column) -> Column:
    """Trimmed; an ascending pair of years joined by a hyphen becomes an interval."""
    t = F.trim(text)
    pair = t.rlike(r"^\d{4}-\d{4}$") & (F.substring(t, 1, 4) < F.substring(t, 6, 4))
    return F.when(pair, F.concat(F.substring(t, 1, 4), F.lit("/"), F.substring(t, 6, 4))).otherwise(t)


def is_duration(text: Column) -> Column:
    return F.trim(text).rlike(r"^P(\d+[YMWD])*(T(\d+[HMS])+)?$") & (F.length(F.trim(text)) > 1)


def _day(y: Column, m: Column | int = 1, d: Column | int = 1) -> Column:
    two = lambda v: F.lpad(v.cast("string"), 2, "0") if isinstance(v, Column) else F.lit(f"{v:02d}")
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), two(m), two(d)), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), two(m), two(d)))


def _one(t: Column, end: bool) -> Column:
    wide = t.rlike("[~?%]$")
    year = F.when(t.rlike(r"^\d{4}"), F.substring(t, 1, 4).cast("int"))
    step = F.when(wide, 1).otherwise(0)
    first_of_month = F.when(t.rlike(r"^\d{4}-\d{2}"), _day(year, F.substring(t, 6, 2).cast("int")))
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), _day(year, F.substring(t, 6, 2).cast("int"), F.substring(t, 9, 2).cast("int")))
    decade = F.when(t.rlike(_DECADE), F.substring(t, 1, 3).cast("int") * 10)
    century = F.when(t.rlike(_CENTURY), F.substring(t, 1, 2).cast("int") * 100)
    if end:
        return (
            F.when(t.rlike(_YEAR), _day(F.least(year + 1 + step, F.lit(9999))))
            .when(t.rlike(_MONTH), F.add_months(first_of_month, 1 + step))
            .when(t.rlike(_DAY), F.date_add(day, 1 + step))
            .when(t.rlike(_DECADE), _day(F.least(decade + 10, F.lit(9999))))
            .when(t.rlike(_CENTURY), _day(F.least(century + 100, F.lit(9999))))
        )
    return (
        F.when(t.rlike(_YEAR), _day(F.greatest(year - step, F.lit(1))))
        .when(t.rlike(_MONTH), F.add_months(first_of_month, -step))
        .when(t.rlike(_DAY), F.date_sub(day, step))
        .when(t.rlike(_DECADE), _day(F.greatest(decade, F.lit(1))))
        .when(t.rlike(_CENTURY), _day(F.greatest(century, F.lit(1))))
    )


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _side(edtf: Column, nth: int) -> Column:
    return _bind(normalised(edtf), lambda t: _bind(F.when(t.contains("/"), F.trim(F.substring_index(t, "/", nth))).otherwise(t), lambda one: _one(one, nth < 0)))


def start(edtf: Column) -> Column:
    return _side(edtf, 1)


def end(edtf: Column) -> Column:
    return _side(edtf, -1)


def precision(edtf: Column) -> Column:
    return _bind(normalised(edtf), _precision)


def _precision(t: Column) -> Column:
    return F.when(t.isNull() | (t == ""), "unknown").when(is_duration(t), "unknown").when(t.contains("/"), "interval").when(t.rlike(_DECADE), "decade").when(t.rlike(_CENTURY), "century").when(t.rlike(_YEAR), "year").when(t.rlike(_MONTH), "month").when(t.rlike(_DAY), "day").otherwise("unknown")


def overlaps(begin: Column, stop: Column, query_begin: Column, query_stop: Column) -> Column:
    """Half-open overlap; a missing bound is open."""
    return (stop.isNull() | query_begin.isNull() | (stop > query_begin)) & (begin.isNull() | query_stop.isNull() | (begin < query_stop))

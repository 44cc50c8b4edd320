"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_number(name: str | Column) -> Column:
    """'01' to '12' for an English month name in any case; other names raise."""
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")])
    got = F.try_element_at(table, F.lower(F.trim(_c(name))))
    return F.coalesce(got, F.raise_error(F.concat(F.lit("not a month: "), _c(name))))


def is_text(value: str | Column, required: bool) -> Column:
    """True where not required, or longer than one character; else null."""
    return F.lit(True) if not required else F.when(F.length(_c(value)) > 1, True)


def is_yes_no(value: str | Column, required: bool) -> Column:
    """Required: y or n; optional: only the empty string."""
    v = F.lower(_c(value))
    return F.coalesce(v.isin("y", "n") if required else v == "", F.lit(False))


def is_number(value: str | Column, required: bool) -> Column:
    """Required: digits only; optional: always false, as in the original."""
    return F.coalesce(_c(value).rlike("^[0-9]+$"), F.lit(False)) if required else F.lit(False)


def is_date(value: str | Column, pattern: str) -> Column:
    return F.try_to_timestamp(_c(value), F.lit(pattern)).isNotNull()


def time_between(start: str | Column, end: str | Column) -> Column:
    """Interval between two times of day (HH:mm:ss)."""
    day = lambda x: F.to_timestamp(F.concat(F.lit("2000-01-01 "), _c(x)))
    return day(end) - day(start)


def time_of_day() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def date_label(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "MMM-dd-yyyy")


def insert_at(text: str | Column, at: Column, piece: Column) -> Column:
    """``piece`` before the 0-based place ``at``."""
    t = _c(text)
    return F.concat(F.substring(t, F.lit(1), at), piece, F.substring(t, at + 1, F.length(t)))


def delete_at(text: str | Column, at: Column) -> Column:
    t = _c(text)
    return F.concat(F.substring(t, F.lit(1), at), F.substring(t, at + 2, F.length(t)))


def replace_at(text: str | Column, at: Column, piece: Column) -> Column:
    return F.overlay(_c(text), piece, at + 1, F.lit(1))


def strip(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def round_even(value: str | Column, digits: int) -> Column:
    return F.bround(_c(value), digits)


def is_numeric(text: str | Column) -> Column:
    return F.coalesce(_c(text).rlike("^[0-9]+$"), F.lit(False))

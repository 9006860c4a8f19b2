"""Date and time expressions, with week from Monday, Sunday = 0 and boundary-counting differences."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"hour": 3600, "minute": 60, "second": 1}


def from_millis(c: Column) -> Column:
    """Timestamp of an epoch in milliseconds."""
    return F.timestamp_millis(c.cast("long"))


def dow0(c: Column) -> Column:
    """Day of week, Sunday = 0."""
    return F.dayofweek(c) - 1


def date_key(c: Column) -> Column:
    """yyyymmdd as an integer."""
    return F.date_format(c, "yyyyMMdd").cast("int")


def trunc_date(c: Column, part: str) -> Column:
    """First day of a week, month, quarter or year, as a date."""
    return F.date_trunc(part, c).cast("date")


def padded(c: Column, pattern: str, width: int = 9) -> Column:
    """A month or day name blank-padded to a fixed width, as some engines print it."""
    return F.rpad(F.date_format(c, pattern), width, " ")


def days_between(end: Column, start: Column) -> Column:
    """Whole days from ``start`` to ``end``."""
    return F.datediff(end, start)


def boundaries(part: str, start: Column, end: Column) -> Column:
    """Number of ``part`` boundaries crossed from ``start`` to ``end`` (Jan 31 to Feb 1 is one month).

    Weeks are whole weeks plus the turn of the week that the weekdays tell, hours and smaller parts count their own edges.
    """
    if part == "year":
        n = F.year(end) - F.year(start)
    elif part == "quarter":
        n = (F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start)
    elif part == "month":
        n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    elif part == "day":
        n = F.datediff(end, start)
    elif part == "week":
        d = F.datediff(end, start)
        whole = F.when(d >= 0, F.floor(d / 7)).otherwise(F.ceil(d / 7))
        # equal weekdays included, a turn backwards counts one week more
        forward = start <= end
        turned = F.when(F.dayofweek(start) <= F.dayofweek(end), F.when(forward, 0).otherwise(-1)).otherwise(F.when(forward, 1).otherwise(0))
        n = whole + turned
    elif part in _SECONDS:
        size = _SECONDS[part]
        n = F.floor(F.unix_timestamp(end.cast("timestamp")) / size) - F.floor(F.unix_timestamp(start.cast("timestamp")) / size)
    elif part in ("millisecond", "microsecond"):
        a, b = (F.unix_micros(x.cast("timestamp")) for x in (start, end))
        n = F.floor(b / 1000) - F.floor(a / 1000) if part == "millisecond" else b - a
    else:
        raise ValueError(f"unknown date part: {part}")
    return n.cast("long")


def add(part: str, n: Column | int, c: Column) -> Column:
    """``c`` plus so many parts, as a timestamp; a day past a month's end becomes its last day."""
    n = n if isinstance(n, Column) else F.lit(n)
    months = {"month": 1, "quarter": 3, "year": 12}
    if part in months:
        return c.cast("timestamp") + F.make_ym_interval(F.lit(0), (n * months[part]).cast("int"))
    days = {"day": 1, "week": 7}
    if part in days:
        return c.cast("timestamp") + F.make_dt_interval((n * days[part]).cast("int"))
    return c.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n * _SECONDS[part])


def last_of(part: str, c: Column) -> Column:
    """Last day of the week, month, quarter or year that holds ``c``."""
    size = {"week": ("day", 7), "month": ("month", 1), "quarter": ("month", 3), "year": ("month", 12)}[part]
    return F.date_sub(add(size[0], size[1], F.date_trunc(part, c)).cast("date"), 1)


def is_last_of(part: str, c: Column) -> Column:
    """Whether a date is the last day of its month, quarter or year."""
    return c.cast("date") == last_of(part, c)


def week_of_month(c: Column) -> Column:
    return F.ceil(F.dayofmonth(c) / 7).cast("int")


def day_of_quarter(c: Column) -> Column:
    return F.datediff(c, F.trunc(c, "quarter")) + 1


def year_of_period(c: Column) -> Column:
    """Year of a period label such as ``2024``, ``202403`` or ``2024Q1``; null where there is none."""
    return F.substring(F.trim(c.cast("string")), 1, 4).try_cast("int")


def dates_between(start: str, end: str | None = None, fmt: str = "%Y%m%d") -> list[str]:
    """Compile-time list of the days from ``start`` to ``end`` (both included) in a format."""
    a = datetime.strptime(start, fmt).date()
    b = datetime.strptime(end, fmt).date() if end else a
    if b < a:
        raise ValueError("the end lies before the start")
    return [(a + timedelta(days=i)).strftime(fmt) for i in range((b - a).days + 1)]


def months_of(start: date, end: date) -> list[tuple[date, date]]:
    """The periods (first day, first day of the next) of each month that touches the range: batches of a microbatch run."""
    out, at = [], start.replace(day=1)
    while at <= end:
        nxt = (at.replace(day=28) + timedelta(days=4)).replace(day=1)
        out.append((at, nxt))
        at = nxt
    return out

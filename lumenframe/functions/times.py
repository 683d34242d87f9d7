"""Calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_date(ts: C, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(_c(ts), zone), "yyyy-MM-dd")


def fixed_offset_day(ts: C, seconds: int = 10800) -> Column:
    """Day number at a fixed offset from UTC."""
    return F.floor((F.unix_micros(_c(ts).cast("timestamp")) / 1e6 + seconds) / 86400).cast("long")


def ordinal_date(year: C, day_of_year: C) -> Column:
    return F.date_add(F.make_date(_c(year), F.lit(1), F.lit(1)), (_c(day_of_year) - 1).cast("int"))


def mid_time(a: C, b: C) -> Column:
    return F.timestamp_micros(((F.unix_micros(_c(a).cast("timestamp")) + F.unix_micros(_c(b).cast("timestamp"))) / 2).cast("long"))


def months_between_inclusive(first: C, last: C) -> Column:
    """First days of every month from first's to last's."""
    return F.sequence(F.trunc(_c(first), "month"), F.trunc(_c(last), "month"), F.expr("interval 1 month"))


def eligible_months(as_of: C, count: int, delay_days: int = 31) -> Column:
    """First days of the latest `count` months whose end lies at least delay_days before as_of."""
    month = lambda k: F.add_months(F.trunc(_c(as_of).cast("date"), "month"), -k)
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(count + 2)), month), lambda m: F.date_add(F.last_day(m), delay_days + 1) <= _c(as_of).cast("date"))

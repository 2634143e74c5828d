"""Calendar arithmetic on zone-less timestamps.

``date_trunc`` and ``unix_timestamp`` read a zone-less timestamp in the session
zone. The functions here build on ``to_date``, ``hour`` and day-time intervals
instead, so results do not depend on that zone.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.schemas import SLOT_MINUTES, SLOTS_PER_DAY

CALENDAR_FEATURES = [
    "interval_of_day",
    "hour",
    "minute",
    "dayofweek",
    "dayofmonth",
    "weekofyear",
    "is_weekend",
]


def moment(value: dt.date | dt.datetime) -> Column:
    """A zone-less literal; ``F.lit`` of a datetime would read it in some zone."""
    return F.lit(value.isoformat()).cast("timestamp_ntz")


def _at(ds: Column, hours: Column, minutes: Column) -> Column:
    return F.to_date(ds).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours, minutes)


def slot_start(ds: Column) -> Column:
    """Floor to the 15-minute slot."""
    return _at(ds, F.hour(ds), F.minute(ds) - F.minute(ds) % SLOT_MINUTES)


def hour_start(ds: Column) -> Column:
    return _at(ds, F.hour(ds), F.lit(0))


def minute_of_day(ds: Column) -> Column:
    return F.hour(ds) * 60 + F.minute(ds)


def interval_of_day(ds: Column) -> Column:
    """Slot number within the day, 0 to 95."""
    return F.hour(ds) * 4 + F.floor(F.minute(ds) / SLOT_MINUTES).cast("int")


def slot_index(ds: Column) -> Column:
    """Slots since 1970-01-01 00:00, a gap-free integer time axis."""
    return F.unix_date(F.to_date(ds)).cast("long") * SLOTS_PER_DAY + interval_of_day(ds)


def slot_time(date: Column, interval: Column) -> Column:
    """Timestamp of a slot number on a date; the inverse of ``interval_of_day``."""
    return date.cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), (interval * SLOT_MINUTES).cast("int")
    )


def is_weekend(ds: Column) -> Column:
    return (F.weekday(ds) >= 5).cast("int")


def with_calendar(df: DataFrame, ds: str = "ds") -> DataFrame:
    """Add the seven calendar features; ``dayofweek`` counts from Monday = 0."""
    t = F.col(ds)
    return df.withColumns(
        {
            "hour": F.hour(t),
            "minute": F.minute(t),
            "interval_of_day": interval_of_day(t),
            "dayofweek": F.weekday(t),
            "dayofmonth": F.dayofmonth(t),
            "weekofyear": F.weekofyear(t),
            "is_weekend": is_weekend(t),
        }
    )


def business_range(
    start: dt.date, end: dt.date, shift: Column | None = None
) -> tuple[Column, Column]:
    """First and last slot of the business days ``start`` to ``end``, inclusive.

    ``shift`` is how long after midnight the business day begins.
    """
    first = moment(start)
    last = slot_time(F.lit(end), F.lit(SLOTS_PER_DAY - 1))
    if shift is None:
        return first, last
    return first + shift, last + shift


def to_business_time(ds: Column, shift: Column) -> Column:
    """Clock time to business time: the business day then starts at 00:00."""
    return ds - shift


def to_clock_time(ds: Column, shift: Column) -> Column:
    return ds + shift


def belongs_to_time(ds: Column, shift: Column) -> Column:
    """Move slots before the business start to the previous date, keeping the time.

    ``shift`` is shorter than a day.
    """
    previous_day = ds - F.expr("INTERVAL '1' DAY")
    before_start = F.to_date(ds - shift) < F.to_date(ds)
    return F.when(before_start, previous_day).otherwise(ds)

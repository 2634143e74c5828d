"""Dense grids, date spines and future frames.

A dense day is built as one array of 96 slots per series and date. Only the
sparse facts and one row per series and date are shuffled; the dense rows come
into being after the join and never cross the network.
"""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.calendar import interval_of_day, slot_time
from slotcast.schemas import KEYS, SLOTS_PER_DAY


def date_spine(keys: DataFrame, start: dt.date, end: dt.date, name: str = "date") -> DataFrame:
    """Every key with every date from ``start`` to ``end``."""
    return keys.withColumn(name, F.explode(F.sequence(F.lit(start), F.lit(end))))


def day_arrays(
    facts: DataFrame,
    start: dt.date,
    end: dt.date,
    value: str = "y",
    fill: float = 0.0,
    keys: list[str] = KEYS,
) -> DataFrame:
    """One row ``(keys, date, values)`` per series and date, 96 values in slot order.

    ``facts`` has at most one row per series and slot; a duplicate slot fails
    the query.
    """
    known = (
        facts.withColumns({"date": F.to_date("ds"), "_slot": interval_of_day(F.col("ds"))})
        .filter(F.col("date").between(F.lit(start), F.lit(end)))
        .groupBy(*keys, "date")
        .agg(F.map_from_entries(F.collect_list(F.struct("_slot", value))).alias("_known"))
    )
    # Series without a row inside the range are still filled.
    spine = date_spine(facts.select(*keys).distinct(), start, end)
    slots = F.sequence(F.lit(0), F.lit(SLOTS_PER_DAY - 1))
    values = F.transform(
        slots, lambda s: F.coalesce(F.try_element_at(F.col("_known"), s), F.lit(fill))
    )
    return spine.join(known, [*keys, "date"], "left").select(
        *keys, "date", values.alias("values")
    )


def dense_slots(
    facts: DataFrame,
    start: dt.date,
    end: dt.date,
    value: str = "y",
    fill: float = 0.0,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Every 15-minute slot from ``start`` to ``end`` for every series, gaps filled."""
    days = day_arrays(facts, start, end, value, fill, keys)
    slots = days.select(*keys, "date", F.posexplode("values").alias("_slot", value))
    return slots.select(
        slot_time(F.col("date"), F.col("_slot")).alias("ds"), *keys, value
    )


def dense_days(daily: DataFrame, date: str, keys: list[str]) -> DataFrame:
    """Every date between the first and last of each key; gaps stay NULL."""
    span = daily.groupBy(*keys).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    spine = span.select(*keys, F.explode(F.sequence("_first", "_last")).alias(date))
    return spine.join(daily, [*keys, date], "left")


def future_slots(history: DataFrame, days: int, keys: list[str] = KEYS) -> DataFrame:
    """The ``days * 96`` slots after the last row of each series."""
    last = history.groupBy(*keys).agg(F.max("ds").alias("_last"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(days * SLOTS_PER_DAY)))
    return last.withColumn("_step", steps).select(
        (
            F.col("_last")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_step") * F.lit(15))
        ).alias("ds"),
        *keys,
    )


def history_and_future(history: DataFrame, days: int, keys: list[str] = KEYS) -> DataFrame:
    """Timestamps of the history followed by the future slots."""
    return history.select("ds", *keys).unionByName(future_slots(history, days, keys))


def missing_dates(
    keys: DataFrame, present: DataFrame, date: str, start: dt.date, end: dt.date
) -> DataFrame:
    """Dates of the range that a key has no row for."""
    names = keys.columns
    return date_spine(keys, start, end, date).join(
        present.select(*names, date), [*names, date], "left_anti"
    )


def horizon_coverage(
    keys: DataFrame, present: DataFrame, date: str, start: dt.date, days: int
) -> DataFrame:
    """Rows per key from ``start`` to ``start + days``; partial when fewer than ``days``.

    A key without any row has 0 days.
    """
    last = start + dt.timedelta(days=days)
    found = (
        present.filter(F.col(date).between(F.lit(start), F.lit(last)))
        .groupBy(*keys.columns)
        .agg(F.count(F.lit(1)).alias("days_found"))
    )
    return (
        keys.distinct()
        .join(found, keys.columns, "left")
        .withColumn("days_found", F.coalesce("days_found", F.lit(0)))
        .withColumn("is_partial", (F.col("days_found") < days).cast("int"))
    )

"""Publishable day payloads."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.calendar import belongs_to_time, moment, to_business_time
from slotcast.functions.scalars import blank_zeros
from slotcast.operators.gapfill import day_arrays
from slotcast.schemas import KEYS


def rounded(forecast: DataFrame, digits: int = 2) -> DataFrame:
    """Rounded to the nearest value, ties to the even one."""
    return forecast.withColumn("yhat", F.bround("yhat", digits))


def forecast_pairs(forecast: DataFrame) -> DataFrame:
    """Distinct department and sales type per location."""
    return forecast.select(*KEYS).distinct()


def in_post_window(
    shifted: DataFrame, start: dt.date, end: dt.date, column: str = "ds"
) -> DataFrame:
    """Rows from ``start`` 00:00 up to, not including, the day after ``end``."""
    first, after = moment(start), moment(end + dt.timedelta(days=1))
    return shifted.filter((F.col(column) >= first) & (F.col(column) < after))


def with_belongs_to(df: DataFrame) -> DataFrame:
    """Add the timestamp moved to the business date it belongs to.

    Needs ``start_time_interval`` on each row.
    """
    shifted = belongs_to_time(F.col("ds"), F.col("start_time_interval"))
    return df.withColumn("belongs_to_ds", shifted)


def business_day_arrays(
    forecast: DataFrame, shifts: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """96 values per series and business day, from the business start on.

    In business time a day runs from 00:00 to 23:45, so its slots are in order and
    every day between the bounds is filled without building a clock-time grid.
    A missing department is a series like any other.
    """
    window = F.col("ds").between(moment(start), moment(end + dt.timedelta(days=2)))
    placed = forecast.filter(window).join(
        shifts.select("location_id", "start_time_interval"), "location_id"
    )
    business_ds = to_business_time(F.col("ds"), F.col("start_time_interval"))
    no_department = F.lit(-1)
    business = placed.select(
        business_ds.alias("ds"),
        "location_id",
        "sales_type_id",
        F.coalesce("department_id", no_department).alias("department_id"),
        "yhat",
    )
    days = day_arrays(business, start, end, value="yhat")
    return days.withColumn("department_id", F.nullif("department_id", no_department))


def day_payload(
    forecast: DataFrame, shifts: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """One payload row per series and business day, zeros as empty strings."""
    days = business_day_arrays(rounded(forecast), shifts, start, end)
    return days.select(
        F.col("date").cast("string").alias("belongs_to"),
        blank_zeros(F.col("values")).alias("forecasts"),
        *KEYS,
    )

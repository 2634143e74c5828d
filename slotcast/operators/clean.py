"""Cleaning, filters and de-duplication of the panel."""

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.calendar import business_range, to_business_time
from slotcast.functions.scalars import non_positive
from slotcast.schemas import KEYS

NO_DEPARTMENT = 0


#: Leading hexadecimal digits of the hashes that series are counted by.
_CELL_DIGITS = 3


def fill_department(df: DataFrame) -> DataFrame:
    """A missing department becomes department 0, so the key has no NULL part."""
    department = F.coalesce(F.col("department_id"), F.lit(NO_DEPARTMENT)).cast("long")
    return df.withColumn("department_id", department)


def parse_ds(df: DataFrame, fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    return df.withColumn("ds", F.to_timestamp_ntz("ds", F.lit(fmt)))


def fix_holiday_windows(holidays: DataFrame) -> DataFrame:
    return holidays.withColumn("lower_window", non_positive(F.col("lower_window")))


def at_location(df: DataFrame, location_id: int | None, column: str = "location_id") -> DataFrame:
    return df if location_id is None else df.filter(F.col(column) == location_id)


def forecast_enabled(dimension: DataFrame) -> DataFrame:
    return dimension.filter("forecast_enabled")


def business_days(
    facts: DataFrame, start: dt.date, end: dt.date, shift: str | None = None
) -> DataFrame:
    """Facts of the business days ``start`` to ``end``; ``shift`` names an interval column."""
    first, last = business_range(start, end, F.col(shift) if shift else None)
    return facts.filter(F.col("ds").between(first, last))


def actuals_for_forecast(
    actual: DataFrame,
    sales_type: DataFrame,
    shifts: DataFrame,
    start: dt.date,
    end: dt.date,
    department: DataFrame | None = None,
) -> DataFrame:
    """Actuals of forecast-enabled sales types over business days, in business time.

    Without ``department`` every department's rows stay. With it, rows of a
    department that is not enabled are dropped; rows without one always stay.
    """
    enabled = forecast_enabled(sales_type).select(F.col("id").alias("sales_type_id"))
    facts = actual.join(enabled, "sales_type_id", "left_semi")
    if department is not None:
        disabled = department.filter(~F.col("forecast_enabled"))
        disabled = disabled.select(F.col("id").alias("department_id"))
        facts = facts.join(disabled, "department_id", "left_anti")
    facts = facts.join(shifts.select("location_id", "start_time_interval"), "location_id")
    facts = business_days(facts, start, end, "start_time_interval")
    business_ds = to_business_time(F.col("ds"), F.col("start_time_interval"))
    return fill_department(facts.withColumn("ds", business_ds)).select("ds", *KEYS, "y")


def of_task(df: DataFrame, sales_type_id: int, department_id: int | None = None) -> DataFrame:
    """Rows of one forecast task; no department means all of them."""
    df = df.filter(F.col("sales_type_id") == sales_type_id)
    return df if department_id is None else df.filter(F.col("department_id") == department_id)


def task_series(facts: DataFrame, sales_type: DataFrame) -> DataFrame:
    """The series the forecast tasks work on.

    A location-level sales type has one series per location: its departments are
    added up to one row per slot. A department-level type keeps its departments.
    """
    levels = sales_type.select(F.col("id").alias("sales_type_id"), "level")
    department = F.when(F.col("level") == "L", F.lit(NO_DEPARTMENT)).otherwise(
        F.col("department_id")
    )
    return (
        facts.join(levels, "sales_type_id")
        .withColumn("department_id", department.cast("long"))
        .groupBy("ds", *KEYS)
        .agg(F.sum("y").alias("y"))
    )


def first_per_slot(facts: DataFrame, keys: list[str] = KEYS, value: str = "y") -> DataFrame:
    """One row per series and ``ds``: the smallest value among duplicates.

    A plain aggregate, so duplicates collapse before the shuffle. Afterwards a
    series has at most 96 rows a day, which bounds every per-series window by the
    calendar whatever share of the raw rows the series held.
    """
    return facts.groupBy(*keys, "ds").agg(F.min(value).alias(value))


def sparse_forecast(forecast: DataFrame, value: str = "yhat") -> DataFrame:
    """Positive values only: zero, negative, missing and NaN rows are not stored."""
    column = F.col(value)
    return forecast.filter((column > 0) & ~F.isnan(column))


def time_of_day(df: DataFrame, start_minute: int, end_minute: int) -> DataFrame:
    """Rows whose time of day lies between two times given in minutes, ends included."""
    midnight = F.to_date("ds").cast("timestamp_ntz")

    def at(minute: int) -> Column:
        return midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minute))

    return df.filter(F.col("ds").between(at(start_minute), at(end_minute)))


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0, columns)


def long_enough(df: DataFrame, min_rows: int, keys: list[str] = KEYS) -> DataFrame:
    """Rows of series that have at least ``min_rows`` rows."""
    rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_rows", rows).filter(F.col("_rows") >= min_rows).drop("_rows")


def existing(columns: list[str], df: DataFrame) -> list[str]:
    return [c for c in columns if c in df.columns]


def without_warmup(df: DataFrame, column: str = "lag_672_15min", keep: bool = False) -> DataFrame:
    """Drop rows without a full week of history.

    Must run before NULLs are filled. ``keep=True`` leaves them in, which is what
    filling first amounts to.
    """
    return df if keep else df.filter(F.col(column).isNotNull())


def sampled_series(df: DataFrame, fraction: float, seed: int, keys: list[str] = KEYS) -> DataFrame:
    """All rows of a seeded pseudo-random share of the series.

    The decision is a hash of the key alone, so it needs no shuffle and a series
    is taken whole or not at all. ``series_sample`` takes an exact number of series.
    """
    return df.filter(key_hash(keys, seed) < F.lit(hash_threshold(fraction)))


def chosen_series(
    series: DataFrame, fraction: float, seed: int, keys: list[str] = KEYS
) -> DataFrame:
    """The keys of ``int(n * fraction)`` of the ``n`` distinct series, those with the least hashes.

    Hashes are counted by their first digits, a count that adds up over partitions. Only the
    series that share these digits are ranked with each other, so no task sorts all keys.
    """
    hashed = series.select(*keys).distinct().withColumn("_hash", seeded_hash(keys, seed))
    hashed = hashed.withColumn("_cell", F.substring("_hash", 1, _CELL_DIGITS))
    sizes = hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_size"))
    # A row per cell, 16 ** _CELL_DIGITS at most.
    upto = F.sum("_size").over(Window.orderBy("_cell"))
    count = F.sum("_size").over(Window.partitionBy())
    cells = sizes.select(
        "_cell", (upto - F.col("_size")).alias("_before"), F.floor(count * F.lit(fraction)).alias("_wanted")
    )
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", *keys))
    ranked = hashed.withColumn("_rank", rank).join(cells.filter("_before < _wanted"), "_cell")
    return ranked.filter("_before + _rank <= _wanted").select(*keys)


def series_sample(df: DataFrame, fraction: float, seed: int, keys: list[str] = KEYS) -> DataFrame:
    """All rows of exactly ``int(n * fraction)`` of the ``n`` series, chosen by a seeded hash."""
    t, s = df.alias("t"), chosen_series(df, fraction, seed, keys).alias("s")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"t.{key}").eqNullSafe(F.col(f"s.{key}"))
    return t.join(s, same, "left_semi")


def seeded_hash(keys: list[str], seed: int) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.md5(text)


def key_hash(keys: list[str], seed: int) -> Column:
    return F.substring(seeded_hash(keys, seed), 1, 8)


def hash_threshold(fraction: float) -> str:
    """First 8 hexadecimal digits below which ``fraction`` of all hashes fall."""
    return f"{int(fraction * 16**8):08x}" if fraction < 1 else "g"

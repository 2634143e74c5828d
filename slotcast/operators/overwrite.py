"""Range overwrite: replace the rows of some series and time ranges by new ones."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.calendar import business_range, moment, to_clock_time
from slotcast.operators.clean import sparse_forecast
from slotcast.schemas import FORECAST, KEYS, SALES
from slotcast.sources.snapshots import commit_days, read_days, versions
from slotcast.sources.writers import read_day_partitions, store_day_partitions


def _covered(keys: list[str]) -> Column:
    """Whether row ``t`` lies in scope ``s``. Keys compare null-safe, so a series without
    department is replaced like any other."""
    covered: Column = F.col("t.ds").between(F.col("s.start_ds"), F.col("s.end_ds"))
    for key in keys:
        covered = covered & F.col(f"t.{key}").eqNullSafe(F.col(f"s.{key}"))
    return covered


def outside_ranges(
    table: DataFrame,
    scope: DataFrame,
    keys: list[str] = KEYS,
    bounds: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Rows not covered by ``scope``, a frame ``(keys, start_ds, end_ds)``, ends included.

    ``bounds`` hold every range; rows beyond them pass by without a join.
    """
    s = scope.alias("s")
    if bounds is None:
        return table.alias("t").join(s, _covered(keys), "left_anti")
    near = F.coalesce(F.col("ds").between(*bounds), F.lit(False))
    inside = table.filter(near).alias("t").join(s, _covered(keys), "left_anti")
    return table.filter(~near).unionByName(inside)


def inside_ranges(rows: DataFrame, scope: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows covered by ``scope``."""
    return rows.alias("t").join(scope.alias("s"), _covered(keys), "left_semi")


def replace_ranges(
    table: DataFrame,
    new_rows: DataFrame,
    scope: DataFrame,
    keys: list[str] = KEYS,
    bounds: tuple[Column, Column] | None = None,
) -> DataFrame:
    """The table after deleting the scope and inserting the new rows that lie in it.

    Running it again with the same input changes nothing.
    """
    kept = outside_ranges(table, scope, keys, bounds)
    return kept.unionByName(inside_ranges(new_rows, scope, keys).select(*table.columns))


def replace_actuals(
    actual: DataFrame, new_rows: DataFrame, series: DataFrame, start: dt.datetime, end: dt.datetime
) -> DataFrame:
    """Re-ingest the actuals of the given series between two timestamps."""
    bounds = (moment(start), moment(end))
    return replace_ranges(actual, new_rows, actuals_scope(series, start, end), bounds=bounds)


def actuals_scope(series: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """The given series between two timestamps, as a scope."""
    return series.select(*KEYS).distinct().withColumns(
        {"start_ds": moment(start), "end_ds": moment(end)}
    )


def replace_forecasts(
    forecast: DataFrame,
    new_rows: DataFrame,
    shifts: DataFrame,
    start: dt.date,
    end: dt.date,
    keep_first_day: bool = False,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Store forecasts made in business time.

    New rows move to clock time and only positive values are stored. The business
    days ``start`` to ``end`` of exactly the forecast series are replaced.
    ``keep_first_day`` with ``keys`` reduced to location and sales type deletes
    from the second day on and across departments instead. Rows beyond the business
    days aren't stored.
    """
    delete, insert, rows = forecast_scope(new_rows, shifts, start, end, keep_first_day, keys)
    # No shift is as long as a day.
    day = dt.timedelta(days=1)
    bounds = (moment(start - day), moment(end + 2 * day))
    kept = outside_ranges(forecast, delete, keys, bounds)
    return kept.unionByName(inside_ranges(rows, insert, keys).select(*forecast.columns))


def forecast_scope(
    new_rows: DataFrame,
    shifts: DataFrame,
    start: dt.date,
    end: dt.date,
    keep_first_day: bool = False,
    keys: list[str] = KEYS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a forecast deletes and may insert, and its positive rows in clock time."""
    shifted = new_rows.join(shifts.select("location_id", "start_time_interval"), "location_id")
    shift = F.col("start_time_interval")
    first, last = business_range(start, end, shift)
    insert = shifted.select(*keys, first.alias("start_ds"), last.alias("end_ds")).distinct()
    delete = insert
    if keep_first_day:
        later = F.col("start_ds") + F.expr("INTERVAL '1' DAY")
        delete = insert.withColumn("start_ds", later)
    in_clock_time = shifted.withColumn("ds", to_clock_time(F.col("ds"), shift))
    return delete, insert, sparse_forecast(in_clock_time)


def store_actuals(
    path: str, new_rows: DataFrame, series: DataFrame, start: dt.datetime, end: dt.datetime
) -> None:
    """``replace_actuals`` on a table stored by date. Only the dates of the range are touched."""
    first, last = start.date(), end.date()
    stored = read_day_partitions(new_rows.sparkSession, path, SALES, first, last)
    days = replace_actuals(stored, new_rows, series, start, end)
    store_day_partitions(path, days, first, last, "actuals")


def store_forecasts(
    path: str,
    new_rows: DataFrame,
    shifts: DataFrame,
    start: dt.date,
    end: dt.date,
    keep_first_day: bool = False,
    keys: list[str] = KEYS,
) -> None:
    """``replace_forecasts`` on a table stored by date.

    Clock time may lie up to a day beside business time, so one more date on either side is read.
    """
    day = dt.timedelta(days=1)
    first, last = start - day, end + day
    stored = read_day_partitions(new_rows.sparkSession, path, FORECAST, first, last)
    days = replace_forecasts(stored, new_rows, shifts, start, end, keep_first_day, keys)
    store_day_partitions(path, days, first, last, "forecasts")


def commit_actuals(
    path: str, new_rows: DataFrame, series: DataFrame, start: dt.datetime, end: dt.datetime
) -> int:
    """``replace_actuals`` as one commit to a table of snapshots, which may not exist yet."""
    first, last = start.date(), end.date()
    spark = new_rows.sparkSession
    base = (versions(spark, path) or [0])[-1]
    stored = read_days(spark, path, SALES, first, last)
    return commit_days(path, replace_actuals(stored, new_rows, series, start, end), first, last, base)


def commit_forecasts(
    path: str,
    new_rows: DataFrame,
    shifts: DataFrame,
    start: dt.date,
    end: dt.date,
    keep_first_day: bool = False,
    keys: list[str] = KEYS,
) -> int:
    """``replace_forecasts`` as one commit to a table of snapshots, which may not exist yet."""
    day = dt.timedelta(days=1)
    first, last = start - day, end + day
    spark = new_rows.sparkSession
    base = (versions(spark, path) or [0])[-1]
    stored = read_days(spark, path, FORECAST, first, last)
    days = replace_forecasts(stored, new_rows, shifts, start, end, keep_first_day, keys)
    return commit_days(path, days, first, last, base)

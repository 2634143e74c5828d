"""Production run: forecast every series of the grid, store it and publish it."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.calendar import moment, with_calendar
from slotcast.operators import blend, boosted
from slotcast.operators import weather as wx
from slotcast.operators.clean import (
    actuals_for_forecast,
    first_per_slot,
    long_enough,
    task_series,
    without_warmup,
)
from slotcast.operators.features import future_features, future_frame, production_features
from slotcast.operators.hierarchy import forecast_grid, start_intervals
from slotcast.operators.holidays import holiday_dates, holiday_labels, with_holiday_flag
from slotcast.operators.overwrite import commit_forecasts, replace_actuals, replace_forecasts
from slotcast.operators.profile import with_profile
from slotcast.operators.publish import day_payload
from slotcast.operators.ridge import ridge_future
from slotcast.operators.windows import with_history
from slotcast.schemas import FORECAST, KEYS, WEATHER_VALUES
from slotcast.sources.snapshots import read_days
from slotcast.sources.storage import materialize
from slotcast.sources.writers import write_payload

# Days of history and of forecast.
HISTORY_DAYS = 730
HORIZON_DAYS = 180
# Rows of a full week, which the longest lag looks back.
WEEK_ROWS = 672


@dataclass(frozen=True)
class Store:
    """Production tables."""

    actual: DataFrame
    location: DataFrame
    corporation: DataFrame
    department: DataFrame
    sales_type: DataFrame
    weather: DataFrame
    holiday: DataFrame


def task_history(store: Store, run_date: dt.date, history_days: int = HISTORY_DAYS) -> DataFrame:
    """Actuals of all series in the forecast grid, in business time."""
    shifts = start_intervals(store.location, store.corporation)
    facts = actuals_for_forecast(
        store.actual,
        store.sales_type,
        shifts,
        run_date - dt.timedelta(days=history_days),
        run_date,
    )
    series = task_series(facts, store.sales_type)
    grid = forecast_grid(store.location, store.sales_type, store.department)
    grid = grid.select(*KEYS).fillna(0, ["department_id"])
    return first_per_slot(series.join(grid, KEYS, "left_semi"))


def production_forecast(
    store: Store,
    run_date: dt.date,
    horizon_days: int = HORIZON_DAYS,
    history_days: int = HISTORY_DAYS,
    min_rows: int = 100,
    min_tree_rows: int = boosted.MIN_ROWS,
    params: boosted.TreeParams = boosted.PRODUCTION_PARAMS,
    keep_warmup: bool = False,
    with_history: bool = False,
) -> DataFrame:
    """Forecast ``(ds, keys, yhat)`` in business time for every long enough series.

    ``with_history`` forecasts the timestamps of the history as well. Series too short for the tree model keep the baseline alone.
    """
    history = materialize(task_history(store, run_date, history_days), "history")
    labels = holiday_labels(store.holiday, store.location)
    weathered = wx.with_daily_weather(
        wx.with_postal_code(history, store.location), store.weather
    )
    baseline = ridge_future(
        weathered, horizon_days, labels, WEATHER_VALUES, min_rows, with_history
    )
    baseline = materialize(baseline, "baseline")
    asked = None if with_history else horizon_days
    trees = _tree_future(store, weathered, baseline, params, min_tree_rows, keep_warmup, asked)
    final = blend.blend_or_baseline(baseline, trees, "yhat_b")
    return final.select("ds", *KEYS, F.col("yhat_final").alias("yhat"))


def _tree_future(
    store: Store,
    history: DataFrame,
    baseline: DataFrame,
    params: boosted.TreeParams,
    min_rows: int,
    keep_warmup: bool,
    days: int | None,
) -> DataFrame:
    """Predictions of the trees for ``days`` ahead, or for all timestamps of the baseline."""
    dates = holiday_dates(store.holiday, by_corporation=True)
    matrix = with_profile(with_history(with_calendar(history)))
    matrix = with_holiday_flag(matrix, dates, store.location)
    matrix = long_enough(without_warmup(matrix, keep=keep_warmup), min_rows)
    rows, names = production_features(materialize(matrix, "matrix"), keep_warmup=True)
    rows = materialize(rows, "features")
    if rows.isEmpty():
        return rows.select("ds", *KEYS, F.lit(None).cast("double").alias("yhat_b"))
    model = boosted.fit_trees(boosted.with_validation(rows), names, params)
    trained = rows.select(*KEYS).distinct()
    known = history.select("ds", *KEYS, "y").join(trained, KEYS, "left_semi")
    if days is None:
        ahead = baseline.select("ds", *KEYS).join(trained, KEYS, "left_semi")
        future = future_features(ahead, known, store.location, store.holiday)
    else:
        future = future_frame(known, days, store.location, store.holiday)
    predicted = boosted.predict_trees(model, future.fillna(0, names), names)
    return blend.post_process(predicted, "yhat_b", quiet_rule=False)


def run_status(
    store: Store,
    run_date: dt.date,
    history_days: int = HISTORY_DAYS,
    min_rows: int = 100,
    min_tree_rows: int = boosted.MIN_ROWS,
    keep_warmup: bool = False,
) -> DataFrame:
    """What becomes of every series of the grid, so that none vanishes silently.

    Rows ``(keys, n_rows, n_tree_rows, status)``. The status is ``no_history``, ``too_short`` for
    any model, ``baseline`` without the tree model for want of rows, or ``blended``. A series
    whose location, sales type or department the grid lacks has no row.
    """
    history = task_history(store, run_date, history_days)
    lag = F.lag("y", WEEK_ROWS).over(Window.partitionBy(*KEYS).orderBy("ds"))
    usable = F.lit(True) if keep_warmup else F.col("_lag").isNotNull()
    sizes = history.withColumn("_lag", lag).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(usable).alias("n_tree_rows")
    )
    grid = forecast_grid(store.location, store.sales_type, store.department)
    series = grid.select(*KEYS).fillna(0, ["department_id"]).distinct()
    found = series.join(sizes, KEYS, "left").fillna(0, ["n_rows", "n_tree_rows"])
    status = (
        F.when(F.col("n_rows") == 0, "no_history")
        .when(F.col("n_rows") < min_rows, "too_short")
        .when(F.col("n_tree_rows") < max(min_tree_rows, 1), "baseline")
        .otherwise("blended")
    )
    return found.withColumn("status", status)


def run(
    store: Store,
    run_date: dt.date,
    folder: str,
    horizon_days: int = HORIZON_DAYS,
    history_days: int = HISTORY_DAYS,
    min_rows: int = 100,
    min_tree_rows: int = boosted.MIN_ROWS,
    params: boosted.TreeParams = boosted.PRODUCTION_PARAMS,
    keep_warmup: bool = False,
) -> int:
    """Forecast, store and publish; returns the snapshot of the forecast table.

    ``folder`` gets the table of snapshots ``forecast``, and for this run the day payloads
    ``payload/<run date>`` and the status of every series ``status/<run date>``. The forecast is
    published last but the payload, which is read from it. A repeated run replaces its days.
    """
    spark = store.actual.sparkSession
    last = run_date + dt.timedelta(days=horizon_days - 1)
    status = run_status(store, run_date, history_days, min_rows, min_tree_rows, keep_warmup)
    status.write.mode("overwrite").parquet(f"{folder}/status/{run_date}")
    forecast = production_forecast(
        store, run_date, horizon_days, history_days, min_rows, min_tree_rows, params, keep_warmup
    )
    shifts = start_intervals(store.location, store.corporation)
    table = f"{folder}/forecast"
    version = commit_forecasts(table, materialize(forecast, "forecast"), shifts, run_date, last)
    # Clock time may lie up to a day behind business time.
    day = dt.timedelta(days=1)
    stored = read_days(spark, table, FORECAST, run_date - day, last + day, version)
    write_payload(publish(stored, store, run_date, last), f"{folder}/payload/{run_date}", "overwrite")
    return version


def store_forecast(
    stored: DataFrame, forecast: DataFrame, store: Store, start: dt.date, end: dt.date
) -> DataFrame:
    """The forecast table after the run."""
    return replace_forecasts(
        stored, forecast, start_intervals(store.location, store.corporation), start, end
    )


def publish(stored: DataFrame, store: Store, start: dt.date, end: dt.date) -> DataFrame:
    shifts = start_intervals(store.location, store.corporation)
    return day_payload(stored, shifts, start, end)


def reingest_actuals(
    store: Store,
    new_rows: DataFrame,
    corporation_id: int,
    start: dt.datetime,
    end: dt.datetime,
) -> DataFrame:
    """The actuals after replacing a corporation's whole grid between two timestamps.

    New rows outside the grid or the range are not taken.
    """
    grid = forecast_grid(
        store.location.filter(F.col("corporation_id") == corporation_id),
        store.sales_type,
        store.department,
    ).select(*KEYS)
    bounds = F.col("ds").between(moment(start), moment(end))
    g, n = grid.alias("g"), new_rows.filter(bounds).alias("n")
    same = F.lit(True)
    for key in KEYS:
        same = same & F.col(f"g.{key}").eqNullSafe(F.col(f"n.{key}"))
    return replace_actuals(store.actual, n.join(g, same, "left_semi"), grid, start, end)

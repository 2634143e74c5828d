"""Feature matrices for the boosted-tree model."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.calendar import slot_time, with_calendar
from slotcast.functions.scalars import typical_open
from slotcast.operators import holidays as hol
from slotcast.operators import weather as wx
from slotcast.operators.clean import existing, without_warmup
from slotcast.operators.median import column_medians
from slotcast.operators.profile import PROFILE, attach_profile, interval_profile, series_profile
from slotcast.operators.profile import series_statistics, with_profile
from slotcast.operators.windows import (
    LAGS,
    ROLLING,
    ZERO_WINDOWS,
    in_chunks,
    with_history,
    with_same_interval_lags,
    with_spike,
)
from slotcast.schemas import KEYS, SLOT_MINUTES, SLOTS_PER_DAY, WEATHER_VALUES

# The feature lists of the evaluation and the production model.
EVALUATION_FEATURES = [
    "interval_of_day", "hour", "minute", "dayofweek", "dayofmonth", "weekofyear", "is_weekend",
    "lag_1_15min", "lag_4_15min", "lag_8_15min", "lag_96_15min", "lag_672_15min",
    "rolling_mean_4_15min", "rolling_std_4_15min",
    "rolling_mean_8_15min", "rolling_std_8_15min",
    "rolling_mean_96_15min", "rolling_std_96_15min",
    "prev_was_zero", "zeros_in_last_4", "zeros_in_last_96",
    "interval_mean", "interval_median", "interval_std", "interval_zero_rate",
    "typical_open", "is_spike",
    "same_interval_lag_1_day", "same_interval_lag_2_day",
    "same_interval_lag_3_day", "same_interval_lag_4_day",
    "real_feel", "precipitation", "snow", "coverage",
    "is_holiday",
]
_EVALUATION_ONLY = {"is_spike", *[f"same_interval_lag_{i}_day" for i in range(1, 5)]}
PRODUCTION_FEATURES = [f for f in EVALUATION_FEATURES if f not in _EVALUATION_ONLY]
# Weather assumed for the future.
FUTURE_WEATHER = {"real_feel": 20.0, "precipitation": 0.0, "snow": 0.0, "coverage": 0.0}


def feature_matrix(
    panel: DataFrame,
    location: DataFrame,
    weather: DataFrame | None,
    holidays: DataFrame,
    train_only: str | None = None,
    holiday_scope: str = "corporation",
    rows_per_day: int = 1,
    chunk_rows: int | None = None,
) -> DataFrame:
    """All evaluation features of the panel, NULLs not yet filled.

    ``train_only`` names a flag column: profiles then see flagged rows only, and
    ``is_spike``, which reads the row's own value, is left out. ``chunk_rows``
    evaluates the row windows over pieces of long series.
    """
    # The joins come first: they would shuffle far wider rows after the windows.
    scope = location if holiday_scope == "corporation" else None
    dates = hol.holiday_dates(holidays, by_corporation=scope is not None)
    df = hol.with_holiday_flag(panel, dates, scope)
    df = with_calendar(wx.with_hourly_weather(wx.with_postal_code(df, location), weather))
    if chunk_rows is None:
        df = with_history(df)
    else:
        df = in_chunks(df, with_history, chunk_rows)
    if train_only is None:
        df = with_spike(df)
    df = with_same_interval_lags(df, rows_per_day=rows_per_day)
    return with_profile(df, train_only)


def fill_with_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace NULLs by the column's exact median, 0 for a column without values."""
    medians = column_medians(df, columns).select(*[F.col(c).alias(f"_{c}") for c in columns])
    filled = {c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0.0)) for c in columns}
    # The medians are one row.
    joined = df.crossJoin(F.broadcast(medians))
    return joined.withColumns(filled).drop(*[f"_{c}" for c in columns])


def ready_features(
    features: DataFrame,
    feature_list: list[str],
    median_columns: list[str],
    keep_warmup: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Rows and feature names to train on.

    Drops warm-up rows, then fills: medians for ``median_columns``, 0 elsewhere.
    Features the frame does not have are left out of the list.
    """
    names = existing(feature_list, features)
    rows = without_warmup(features, keep=keep_warmup)
    by_median = existing(median_columns, rows)
    if by_median:
        rows = fill_with_medians(rows, by_median)
    return rows.fillna(0, [n for n in names if n not in by_median]), names


def evaluation_features(
    features: DataFrame, keep_warmup: bool = False
) -> tuple[DataFrame, list[str]]:
    return ready_features(features, EVALUATION_FEATURES, PROFILE, keep_warmup)


def production_features(
    features: DataFrame, keep_warmup: bool = False
) -> tuple[DataFrame, list[str]]:
    return ready_features(features, PRODUCTION_FEATURES, WEATHER_VALUES, keep_warmup)


def _unknown_history() -> dict[str, Column]:
    columns = {f"lag_{n}_15min": F.col("y_mean") for n in LAGS}
    columns |= {f"rolling_mean_{n}_15min": F.col("y_mean") for n in ROLLING}
    columns |= {f"rolling_std_{n}_15min": F.col("y_std") for n in ROLLING}
    columns["prev_was_zero"] = F.col("y_zero_rate")
    columns |= {f"zeros_in_last_{n}": F.col("y_zero_rate") * n for n in ZERO_WINDOWS}
    return columns | {name: F.lit(value) for name, value in FUTURE_WEATHER.items()}


def future_frame(
    history: DataFrame, days: int, location: DataFrame, holidays: DataFrame
) -> DataFrame:
    """``future_features`` of the ``days * 96`` slots after the last row of each series.

    All joins are of one row per series and date, which carries its weekday's 96 profile cells as
    one map; slots are told apart only behind them, so no exploded row is shuffled. Rows of the
    history lie on the 15-minute grid.
    """
    ahead = F.make_dt_interval(F.lit(days))
    slot = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(SLOT_MINUTES))
    series = history.groupBy(*KEYS).agg(
        F.max("ds").alias("_last"), *[c.alias(n) for n, c in series_statistics().items()]
    )
    dates = F.sequence(F.to_date(F.col("_last") + slot), F.to_date(F.col("_last") + ahead))
    dated = series.withColumn("date", F.explode(dates)).withColumn("dayofweek", F.weekday("date"))
    cells = interval_profile(with_calendar(history))
    cell = F.struct("interval_of_day", F.struct(*PROFILE))
    weekdays = cells.groupBy(*KEYS, "dayofweek").agg(
        F.map_from_entries(F.collect_list(cell)).alias("_cells")
    )
    dated = dated.join(weekdays, [*KEYS, "dayofweek"], "left").drop("dayofweek")
    dated = dated.withColumn("ds", F.col("date").cast("timestamp_ntz")).drop("date")
    dates = hol.holiday_dates(holidays, by_corporation=True)
    dated = hol.with_holiday_flag(dated, dates, location)
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS_PER_DAY - 1)))
    rows = dated.withColumn("_slot", slots).withColumn("ds", slot_time(F.col("ds"), F.col("_slot")))
    rows = rows.filter((F.col("ds") > F.col("_last")) & (F.col("ds") <= F.col("_last") + ahead))
    own = F.try_element_at("_cells", F.col("_slot"))
    rows = with_calendar(rows.withColumns({name: own[name] for name in PROFILE}))
    rows = rows.withColumn("typical_open", typical_open(F.col("interval_zero_rate")))
    unneeded = ["y_mean", "y_std", "y_zero_rate", "_last", "_slot", "_cells"]
    return rows.withColumns(_unknown_history()).drop(*unneeded)


def future_features(
    future: DataFrame, history: DataFrame, location: DataFrame, holidays: DataFrame
) -> DataFrame:
    """Production features of timestamps without actuals.

    Unknown lags take the series mean, unknown deviations the series deviation,
    zero counts the zero rate times the window.
    """
    df = attach_profile(with_calendar(future), interval_profile(with_calendar(history)))
    df = df.join(series_profile(history), KEYS, "left")
    df = df.withColumns(_unknown_history()).drop("y_mean", "y_std", "y_zero_rate")
    return hol.with_holiday_flag(df, hol.holiday_dates(holidays, by_corporation=True), location)

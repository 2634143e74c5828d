"""Baseline forecast in plain column expressions.

``yhat = trend * seasonal index * holiday factor``, each learnt on the training
rows of the series. Every statistic is a window over a partition that contains the
series key, so split, fit and prediction share one exchange and need no join back.
Holiday labels are joined before that exchange, while rows are narrow.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.calendar import interval_of_day, slot_index
from slotcast.operators.holidays import with_holiday_label
from slotcast.operators.windows import with_enough_history, with_split
from slotcast.schemas import KEYS, SLOTS_PER_DAY
from slotcast.sources.storage import materialize

TREND_FLOOR = 1.0


def with_trend(split: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Straight line through the training rows, in days since the first row."""
    series = Window.partitionBy(*keys)
    slot = slot_index(F.col("ds"))
    train_y = F.when(F.col("is_train"), F.col("y"))
    slope = F.coalesce(F.regr_slope(train_y, F.col("x")).over(series), F.lit(0.0))
    level = F.avg(train_y).over(series)
    middle = F.avg(F.when(train_y.isNotNull(), F.col("x"))).over(series)
    return (
        split.withColumn("x", (slot - F.min(slot).over(series)) / SLOTS_PER_DAY)
        .withColumns({"_slope": slope, "_level": level, "_middle": middle})
        .withColumn("line", F.col("_level") + F.col("_slope") * (F.col("x") - F.col("_middle")))
        .withColumn("trend", F.greatest(F.col("line"), F.lit(TREND_FLOOR)))
        .drop("_slope", "_level", "_middle")
    )


def with_seasonal_index(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean of value over trend per weekday and slot, else per slot, else per series."""
    ratio = F.when(F.col("is_train"), F.col("y") / F.col("trend"))

    def mean_by(*cell: str) -> Column:
        return F.avg(ratio).over(Window.partitionBy(*keys, *cell))

    calendar = {"_dow": F.weekday("ds"), "_slot": interval_of_day(F.col("ds"))}
    seasonal = F.coalesce(mean_by("_slot", "_dow"), mean_by("_slot"), mean_by())
    return df.withColumns(calendar).withColumn("seasonal", seasonal).drop("_dow", "_slot")


def with_holiday_factor(labelled: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """How far training rows with the same holiday label lie off; 1 for an unseen label."""
    expected = F.col("trend") * F.col("seasonal")
    off = F.when(
        F.col("is_train") & F.col("holiday_label").isNotNull(),
        F.try_divide(F.col("y"), expected),
    )
    by_label = Window.partitionBy(*keys, "holiday_label")
    return labelled.withColumn("holiday_factor", F.coalesce(F.avg(off).over(by_label), F.lit(1.0)))


def baseline_forecast(
    panel: DataFrame,
    labels: DataFrame | None = None,
    min_rows: int = 100,
    min_train: int = 50,
    min_test: int = 10,
    keys: list[str] = KEYS,
    whole_series: bool = True,
) -> DataFrame:
    """Predictions ``(keys, ds, y, yhat)`` for the held-out end of each long enough series.

    ``panel`` has one row per series and slot. ``labels`` comes from
    ``holidays.holiday_labels``. ``whole_series=False`` gives the same result from
    aggregates and joins, for panels whose series are too long for one task.
    """
    if labels is not None:
        panel = with_holiday_label(panel, labels)
    split = with_split(panel, keys=keys, whole_series=whole_series)
    split = with_enough_history(split, min_rows, min_train, min_test)
    if not whole_series:
        return _forecast_from_aggregates(split, keys)
    fitted = with_seasonal_index(with_trend(split, keys), keys)
    yhat = F.col("trend") * F.col("seasonal")
    if labels is not None:
        fitted = with_holiday_factor(fitted, keys)
        yhat = yhat * F.col("holiday_factor")
    return fitted.filter(~F.col("is_train")).select(*keys, "ds", "y", yhat.alias("yhat"))


def _forecast_from_aggregates(split: DataFrame, keys: list[str]) -> DataFrame:
    """The forecast of split series from statistics that Spark adds up map-side.

    No task holds more of a series than its partial sums; a join in which one
    series dominates is split by adaptive execution. The split rows and the sums are
    written once, as several aggregates read them.
    """
    split = materialize(split, "split")
    trained = split.withColumns(
        {
            "x": slot_index(F.col("ds")) / SLOTS_PER_DAY,
            "_dow": F.weekday("ds"),
            "_slot": interval_of_day(F.col("ds")),
        }
    )
    train = trained.filter("is_train")
    line = train.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("_slope"),
        F.avg("y").alias("_level"),
        F.avg(F.when(F.col("y").isNotNull(), F.col("x"))).alias("_middle"),
    )
    trend = F.greatest(
        F.col("_level") + F.col("_slope") * (F.col("x") - F.col("_middle")), F.lit(TREND_FLOOR)
    )

    def with_line(rows: DataFrame) -> DataFrame:
        return rows.join(line, keys).withColumn("trend", trend)

    ratio = F.col("y") / F.col("trend")
    cell = [*keys, "_slot", "_dow"]
    sums = with_line(train).groupBy(*cell).agg(
        F.sum(ratio).alias("_sum"), F.count(ratio).alias("_count")
    )
    sums = materialize(sums, "season")

    def mean_by(columns: list[str], name: str) -> DataFrame:
        mean = F.try_divide(F.sum("_sum"), F.sum("_count"))
        return sums.groupBy(*columns).agg(mean.alias(name))

    def with_season(rows: DataFrame) -> DataFrame:
        seasonal = F.coalesce("_by_cell", "_by_slot", "_by_series")
        return (
            with_line(rows)
            .join(mean_by(cell, "_by_cell"), cell, "left")
            .join(mean_by(cell[:-1], "_by_slot"), cell[:-1], "left")
            .join(mean_by(keys, "_by_series"), keys, "left")
            .withColumn("seasonal", seasonal)
        )

    expected = F.col("trend") * F.col("seasonal")
    test = with_season(trained.filter(~F.col("is_train")))
    yhat = expected
    if "holiday_label" in split.columns:
        labelled = with_season(train.filter(F.col("holiday_label").isNotNull()))
        factors = labelled.groupBy(*keys, "holiday_label").agg(
            F.avg(F.try_divide(F.col("y"), expected)).alias("_factor")
        )
        test = test.join(factors, [*keys, "holiday_label"], "left")
        yhat = expected * F.coalesce(F.col("_factor"), F.lit(1.0))
    return test.select(*keys, "ds", "y", yhat.alias("yhat"))

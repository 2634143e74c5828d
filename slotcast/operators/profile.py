"""Historical profiles of a series."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.scalars import is_zero, typical_open
from slotcast.schemas import KEYS

CELL = ["interval_of_day", "dayofweek"]
PROFILE = ["interval_mean", "interval_median", "interval_std", "interval_zero_rate"]


def _statistics(value: Column) -> dict[str, Column]:
    zero = F.when(value.isNotNull(), is_zero(value))
    return {
        "interval_mean": F.avg(value),
        "interval_median": F.median(value),
        "interval_std": F.stddev_samp(value),
        "interval_zero_rate": F.avg(zero),
    }


def interval_profile(history: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean, median, deviation and zero rate per series, slot of day and weekday.

    A cell holds one value per week, so the exact median stays small.
    """
    columns = [c.alias(name) for name, c in _statistics(F.col("y")).items()]
    return history.groupBy(*keys, *CELL).agg(*columns)


def attach_profile(df: DataFrame, profile: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Left join of a separately computed profile, with the open flag."""
    joined = df.join(profile, [*keys, *CELL], "left")
    return joined.withColumn("typical_open", typical_open(F.col("interval_zero_rate")))


def with_profile(
    df: DataFrame, train_only: str | None = None, keys: list[str] = KEYS
) -> DataFrame:
    """Profile of a frame attached to its own rows, as windows over the cell.

    The cell contains the series key, so this reuses the partitioning of the row
    windows where an aggregate and a join would shuffle the panel again.
    ``train_only`` names a flag column; only flagged rows then enter the profile.
    """
    value = F.when(F.col(train_only), F.col("y")) if train_only else F.col("y")
    cell = Window.partitionBy(*keys, *CELL)
    columns = {name: c.over(cell) for name, c in _statistics(value).items()}
    return df.withColumns(columns).withColumn(
        "typical_open", typical_open(F.col("interval_zero_rate"))
    )


def series_profile(history: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean, deviation and zero rate of each whole series."""
    return history.groupBy(*keys).agg(*[c.alias(n) for n, c in series_statistics().items()])


def series_statistics() -> dict[str, Column]:
    return {
        "y_mean": F.avg("y"),
        "y_std": F.stddev_samp("y"),
        "y_zero_rate": F.avg(is_zero(F.col("y"))),
    }


def with_zero_rate(df: DataFrame, name: str = "zero_rate", keys: list[str] = KEYS) -> DataFrame:
    """Share of zero actuals per series, on every row."""
    return df.withColumn(name, F.avg(is_zero(F.col("y"))).over(Window.partitionBy(*keys)))


def series_keys(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.select(*keys).distinct()

"""Weather aggregates and regressors."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.calendar import hour_start, moment
from slotcast.functions.scalars import code_part, comfort_level, intensity_level
from slotcast.operators.clean import time_of_day
from slotcast.operators.gapfill import dense_days
from slotcast.schemas import WEATHER_VALUES

# Scale of the daily regressors: both levels run up to 5.
REGRESSOR_SCALE = 5


def hourly_weather(weather: DataFrame) -> DataFrame:
    """Per postal code and hour; missing amounts add up to 0."""
    return weather.groupBy("postal_code", hour_start(F.col("ds")).alias("hour_floor")).agg(
        F.avg("real_feel").alias("real_feel"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.coalesce(F.sum("snow"), F.lit(0.0)).alias("snow"),
        F.avg("coverage").alias("coverage"),
    )


def between_dates(df: DataFrame, start: dt.date, end: dt.date, column: str = "ds") -> DataFrame:
    """Rows between two dates as timestamps: the end date counts up to 00:00."""
    return df.filter(F.col(column).between(moment(start), moment(end)))


def daily_weather(
    weather: DataFrame, start: dt.date, end: dt.date, start_minute: int, end_minute: int
) -> DataFrame:
    """Per postal code and date, from the hours inside a time-of-day slice."""
    rows = time_of_day(between_dates(weather, start, end), start_minute, end_minute)
    return rows.groupBy("postal_code", F.to_date("ds").alias("ds")).agg(
        F.avg("real_feel").alias("real_feel"),
        F.sum("precipitation").alias("precipitation"),
        F.avg("coverage").alias("coverage"),
        F.sum("snow").alias("snow"),
    )


def with_weather_codes(weather: DataFrame) -> DataFrame:
    code = F.col("weather_code")
    return weather.withColumns(
        {
            "coverage_code": code_part(code, 1),
            "intensity_code": code_part(code, 2),
            "weather_code": code_part(code, 3),
        }
    )


def with_weather_levels(coded: DataFrame) -> DataFrame:
    return coded.withColumns(
        {
            "comfort_level": comfort_level(F.col("real_feel")),
            "intensity": intensity_level(F.col("intensity_code"), F.col("weather_code")),
        }
    )


def weather_regressors(
    weather: DataFrame, start: dt.date, end: dt.date, start_minute: int, end_minute: int
) -> DataFrame:
    """Daily mean comfort and intensity per postal code, scaled to 1; gaps are NULL rows."""
    rows = time_of_day(between_dates(weather, start, end), start_minute, end_minute)
    daily = (
        with_weather_levels(with_weather_codes(rows))
        .groupBy("postal_code", F.to_date("ds").alias("ds"))
        .agg(
            (F.avg("comfort_level") / REGRESSOR_SCALE).alias("comfort_level"),
            (F.avg("intensity") / REGRESSOR_SCALE).alias("intensity"),
        )
    )
    return dense_days(daily, "ds", ["postal_code"])


def with_postal_code(df: DataFrame, location: DataFrame) -> DataFrame:
    postal = location.select(F.col("id").alias("location_id"), "postal_code")
    return df.join(postal, "location_id", "left")


def with_hourly_weather(df: DataFrame, weather: DataFrame | None) -> DataFrame:
    """Weather of the row's postal code and hour; zeros when there is no weather table."""
    if weather is None:
        return df.withColumns({c: F.lit(0.0) for c in WEATHER_VALUES})
    keyed = df.withColumn("hour_floor", hour_start(F.col("ds")))
    return keyed.join(
        hourly_weather(weather), ["postal_code", "hour_floor"], "left"
    ).drop("hour_floor")


def with_daily_weather(df: DataFrame, daily: DataFrame, exact: bool = False) -> DataFrame:
    """Daily weather of the row's date.

    ``exact`` matches the timestamp itself, so only midnight rows find a value.
    """
    moment = F.col("ds") if exact else F.to_date("ds")
    days = daily.withColumn(
        "_day", F.col("weather_date").cast("timestamp_ntz" if exact else "date")
    ).drop("weather_date")
    return (
        df.withColumn("_day", moment).join(days, ["postal_code", "_day"], "left").drop("_day")
    )


def with_weather_zone(
    df: DataFrame, postal_zone: DataFrame, zone_scales: DataFrame
) -> DataFrame:
    """Climate zone of the postal code and its prior scales, NULL where unknown."""
    return df.join(postal_zone, "postal_code", "left").join(zone_scales, "zone", "left")

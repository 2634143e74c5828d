"""Location, corporation, department and sales type lookups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.scalars import parse_hours
from slotcast.operators.clean import forecast_enabled


def start_intervals(location: DataFrame, corporation: DataFrame) -> DataFrame:
    """When the business day of each location begins."""
    corporations = corporation.select(
        F.col("id").alias("corporation_id"), "start_time_interval"
    )
    return location.join(corporations, "corporation_id").select(
        F.col("id").alias("location_id"), "corporation_id", "start_time_interval"
    )


def location_attributes(location: DataFrame) -> DataFrame:
    """Corporation, default sales type and parsed opening hours of each location."""
    return location.select(
        F.col("id").alias("location_id"),
        "corporation_id",
        "default_sales_type_forecast",
        parse_hours(F.col("hours")).alias("hours"),
    )


def corporation_members(
    location: DataFrame, sales_type: DataFrame, department: DataFrame
) -> DataFrame:
    """Rows ``(corporation_id, kind, id)``: locations, enabled sales types, departments."""

    def members(df: DataFrame, kind: str) -> DataFrame:
        return df.select("corporation_id", F.lit(kind).alias("kind"), F.col("id").cast("long"))

    return (
        members(location, "location")
        .unionByName(members(forecast_enabled(sales_type), "sales_type"))
        .unionByName(members(department, "department"))
    )


def forecast_grid(
    location: DataFrame, sales_type: DataFrame, department: DataFrame
) -> DataFrame:
    """All series to forecast.

    A location-level sales type has one series per location, without department; a
    department-level type has one per department of the corporation.
    """
    types = forecast_enabled(sales_type).select(
        "corporation_id", F.col("id").alias("sales_type_id"), "level"
    )
    departments = department.select("corporation_id", F.col("id").alias("department_id"))
    places = location.select(F.col("id").alias("location_id"), "corporation_id")
    by_location = (
        types.filter("level = 'L'").withColumn("department_id", F.lit(None).cast("long"))
    )
    by_department = types.filter("level <> 'L'").join(departments, "corporation_id")
    columns = ["corporation_id", "sales_type_id", "level", "department_id"]
    series = by_location.select(*columns).unionByName(by_department.select(*columns))
    return places.join(series, "corporation_id").select(
        "location_id", "sales_type_id", "department_id", "corporation_id", "level"
    )

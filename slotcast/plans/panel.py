"""The tables a run works on."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from slotcast import schemas
from slotcast.operators.clean import (
    at_location,
    fill_department,
    first_per_slot,
    fix_holiday_windows,
)
from slotcast.operators.gapfill import dense_slots
from slotcast.sources import readers


@dataclass(frozen=True)
class Tables:
    sales: DataFrame
    weather: DataFrame
    holiday: DataFrame
    location: DataFrame


def load_csv_tables(
    spark: SparkSession,
    folder: str,
    location_id: int | None = None,
    most_rejected: float | None = None,
) -> Tables:
    """The input files of an evaluation run, cleaned, optionally for one location.

    A field that doesn't parse fails the read; with ``most_rejected`` its row is set aside, up to
    that share of each file.
    """

    def read(name: str, schema: T.StructType) -> DataFrame:
        path = f"{folder}/{name}.csv"
        if most_rejected is None:
            return readers.read_csv(spark, path, schema)
        return readers.load_csv(spark, path, schema, most_rejected).rows

    return Tables(
        sales=at_location(fill_department(read("sales", schemas.SALES)), location_id),
        weather=read("weather", schemas.WEATHER),
        holiday=fix_holiday_windows(read("holiday", schemas.HOLIDAY)),
        location=at_location(read("locations", schemas.LOCATION_CSV), location_id, "id"),
    )


def panel_of(sales: DataFrame, days: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """One row per series and slot, the form every per-series operator expects.

    Lags count rows. With ``days`` every slot between two dates exists, gaps as
    zero, so that rows and time steps are the same.
    """
    panel = first_per_slot(fill_department(sales))
    return panel if days is None else dense_slots(panel, *days)

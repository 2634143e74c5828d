"""Holiday expansion and flags.

Holiday tables are left to Spark's own size check: it broadcasts them when the
measured size allows and shuffles otherwise. Flags are looked up by corporation,
as locations times holidays may be far more rows than the flagged ones.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.operators.clean import fix_holiday_windows


def location_holidays(location: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holidays of each location, through its corporation."""
    places = location.select(F.col("id").alias("location_id"), "corporation_id")
    return places.join(holidays, "corporation_id")


def holiday_days(holidays: DataFrame) -> DataFrame:
    """One row per day of each holiday's window, with its offset from the holiday."""
    offsets = F.sequence(F.col("lower_window"), F.col("upper_window"))
    return (
        fix_holiday_windows(holidays)
        .withColumn("day_offset", F.explode(offsets))
        .withColumn("date", F.date_add("ds", F.col("day_offset")))
        .drop("ds", "lower_window", "upper_window")
    )


def location_scopes(location: DataFrame) -> DataFrame:
    """One row per location with the sorted array of its corporations, nearly always one.

    The locations are dealt out before they are grouped: a file of many is one split, and a
    group's set takes more memory than its row. They are merged into joins, as the file's size,
    by which Spark would broadcast them, is far below that of their rows.
    """
    places = location.select(F.col("id").alias("location_id"), "corporation_id")
    corporations = F.sort_array(F.collect_set("corporation_id")).alias("_scope")
    return places.repartition("location_id").groupBy("location_id").agg(corporations).hint("merge")


def scope_dates(scopes: DataFrame, dates: DataFrame) -> DataFrame:
    """Distinct dates of each distinct set of corporations; ``dates`` has those of a corporation."""
    members = scopes.select("_scope").distinct().select(
        "_scope", F.explode("_scope").alias("corporation_id")
    )
    return members.join(dates, "corporation_id").select("_scope", "date").distinct()


def holiday_dates(
    holidays: DataFrame,
    location: DataFrame | None = None,
    windows: bool = False,
    by_corporation: bool = False,
) -> DataFrame:
    """Distinct holiday dates: per location, per corporation, or else of any corporation.

    Those per location are locations times dates; to flag rows, take those per corporation.
    """
    if windows:
        dated = holiday_days(holidays)
    else:
        dated = holidays.withColumn("date", F.to_date("ds"))
    if location is None and not by_corporation:
        return dated.select("date").distinct()
    dates = dated.select("corporation_id", "date").distinct()
    if location is None:
        return dates
    scopes = location_scopes(location)
    return scopes.join(scope_dates(scopes, dates), "_scope").select("location_id", "date")


def with_holiday_flag(
    df: DataFrame, dates: DataFrame, location: DataFrame | None = None
) -> DataFrame:
    """Add ``is_holiday``; ``dates`` is distinct, so no row is duplicated.

    With ``location`` the ``dates`` are those per corporation, and the rows look up their
    location's corporations, so that locations never meet the dates of rows they don't have.
    """
    df = df.withColumn("date", F.to_date("ds"))
    if location is not None:
        scopes = location_scopes(location)
        dates = scope_dates(scopes, dates)
        df = df.join(scopes, "location_id", "left")
    on = [c for c in ("location_id", "_scope", "date") if c in dates.columns]
    return (
        df.join(dates.withColumn("is_holiday", F.lit(1)), on, "left")
        .withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0)))
        .drop("date", "_scope")
    )


def holiday_labels(holidays: DataFrame, location: DataFrame) -> DataFrame:
    """One label per location and date: the sorted ``holiday:offset`` names in effect.

    A date carries as many names as the corporation has overlapping holidays.
    """
    name = F.concat_ws(":", "holiday", F.col("day_offset").cast("string"))
    per_corporation = (
        holiday_days(holidays)
        .groupBy("corporation_id", "date")
        .agg(F.array_join(F.sort_array(F.collect_set(name)), "+").alias("holiday_label"))
    )
    return location_holidays(location, per_corporation).select(
        "location_id", "date", "holiday_label"
    )


def with_holiday_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``holiday_label``, NULL on ordinary days."""
    dated = df.withColumn("date", F.to_date("ds"))
    return dated.join(labels, ["location_id", "date"], "left").drop("date")

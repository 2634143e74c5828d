"""Data-quality audit of the panel."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.schemas import KEYS


def overview(sales: DataFrame) -> DataFrame:
    """Row count, distinct keys and ranges in one row.

    Distinct counts go through one row per key, which partial aggregation makes
    small before the shuffle.
    """
    per_key = sales.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("ds").alias("first"), F.max("ds").alias("last")
    )
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_series"),
        F.countDistinct("location_id").alias("n_locations"),
        F.min("location_id").alias("min_location_id"),
        F.max("location_id").alias("max_location_id"),
        F.min("first").alias("min_ds"),
        F.max("last").alias("max_ds"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column", "nulls"
    )


def rows_per_location(sales: DataFrame) -> DataFrame:
    return sales.groupBy("location_id").agg(F.count(F.lit(1)).alias("n_rows"))


def column_types(df: DataFrame) -> DataFrame:
    """Rows ``(column, type, non_null)``."""
    counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
    typed = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind).alias("type"),
                F.col(name).alias("non_null"),
            )
            for name, kind in df.dtypes
        ]
    )
    return counted.select(F.explode(typed).alias("r")).select("r.*")


def key_membership(sales: DataFrame, location: DataFrame) -> DataFrame:
    """Every location id with whether it occurs in the sales and in the dimension."""
    ids = location.select(F.col("id").alias("location_id"), F.lit(1).alias("in_locations"))
    sold = sales.select("location_id").distinct().withColumn("in_sales", F.lit(1))
    return sold.join(ids, "location_id", "full").fillna(0, ["in_sales", "in_locations"])


def audit_report(sales: DataFrame, location: DataFrame) -> DataFrame:
    """All checks as rows ``(check, item, value)``."""
    ranges = overview(sales)
    counts = ["n_rows", "n_series", "n_locations", "min_location_id", "max_location_id"]
    totals = ranges.select(*[F.col(c).cast("string") for c in counts]).unpivot(
        [], counts, "item", "value"
    )
    member = key_membership(sales, location)
    membership = member.agg(
        F.count_if(F.col("in_locations") == 0).cast("string").alias("only_in_sales"),
        F.count_if(F.col("in_sales") == 0).cast("string").alias("only_in_locations"),
    ).unpivot([], ["only_in_sales", "only_in_locations"], "item", "value")
    nulls = null_counts(sales).select(
        F.col("column").alias("item"), F.col("nulls").cast("string").alias("value")
    )
    per_location = rows_per_location(sales).select(
        F.col("location_id").cast("string").alias("item"),
        F.col("n_rows").cast("string").alias("value"),
    )
    types = column_types(sales).select(
        F.col("column").alias("item"), F.col("type").alias("value")
    )
    report = None
    for name, part in [
        ("overview", totals),
        ("membership", membership),
        ("nulls", nulls),
        ("rows_per_location", per_location),
        ("types", types),
    ]:
        part = part.select(F.lit(name).alias("check"), "item", "value")
        report = part if report is None else report.unionByName(part)
    return report

"""Sinks.

Writers rebalance instead of repartitioning: adaptive execution then splits a
partition that one large key would otherwise fill, and merges small ones.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotcast.functions.scalars import record_json
from slotcast.sources.storage import materialize

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def write_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    options = {"header": True, "timestampNTZFormat": TIMESTAMP_FORMAT, "compression": compression}
    rows.write.options(**options).csv(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Parquet laid out by location, so one location reads only its own folder."""
    predictions.hint("rebalance", "location_id").write.partitionBy("location_id").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Rows ``(grain, mae)`` as one JSON document per run.

    At most four rows, one per grain, reach the single output task.
    """
    document = metrics.agg(F.map_from_entries(F.collect_list(F.struct("grain", "mae"))).alias("m"))
    grains = ["15min", "hourly", "daily", "combined"]
    document.select(*[F.col("m")[grain].alias(grain) for grain in grains]).write.json(path)


def comparison_document(report: DataFrame, zeros: DataFrame) -> DataFrame:
    """A comparison and its zero metrics as one nested row.

    ``report`` has one row per grain, ``zeros`` one per predictor, so the maps are
    small and the joined side is a single row.
    """

    def by_grain(column: str) -> Column:
        pairs = F.collect_list(F.struct("grain", column))
        return F.map_from_entries(pairs).alias(column)

    scores = report.agg(
        by_grain("baseline_mae"), by_grain("model_mae"), by_grain("improvement_pct")
    )
    rates = F.struct("predictor", F.struct("precision", "recall"))
    zero_metrics = zeros.agg(F.map_from_entries(F.collect_list(rates)).alias("zero_metrics"))
    return scores.crossJoin(F.broadcast(zero_metrics))


def write_comparison(report: DataFrame, zeros: DataFrame, path: str) -> None:
    comparison_document(report, zeros).write.json(path)


def write_payload(payload: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line, one line per series and business day."""
    payload.select(record_json(*payload.columns).alias("value")).write.mode(mode).text(path)


def write_day_partitions(facts: DataFrame, path: str, mode: str = "dynamic") -> None:
    """Write facts by date, sorted by location, replacing only the dates present.

    Rewriting the same days twice leaves the same table, so a retried job is safe.
    """
    (
        facts.withColumn("date", F.to_date("ds"))
        .hint("rebalance", "date")
        .sortWithinPartitions("date", "location_id")
        .write.partitionBy("date")
        .option("partitionOverwriteMode", mode)
        .mode("overwrite")
        .parquet(path)
    )


def read_day_partitions(
    spark: SparkSession, path: str, schema: T.StructType, first: dt.date, last: dt.date
) -> DataFrame:
    """Facts of some dates; other partitions aren't read."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("date", T.DateType())])).parquet(path)
    return rows.filter(F.col("date").between(F.lit(first), F.lit(last))).drop("date")


def store_day_partitions(
    path: str, days: DataFrame, first: dt.date, last: dt.date, label: str = "days"
) -> None:
    """Replace the dates from ``first`` to ``last`` of a table by ``days``.

    ``days`` may be derived from the same dates, so it's written to the shared folder
    before any partition changes. Dates of the range left without rows become empty.
    """
    spark = days.sparkSession
    staged = materialize(days, label)
    write_day_partitions(staged, path)
    # At most one row per date of the range on either side.
    there = read_day_partitions(spark, path, staged.schema, first, last)
    dates = F.to_date("ds").alias("date")
    emptied = there.select(dates).distinct().exceptAll(staged.select(dates).distinct()).collect()
    for row in emptied:
        staged.limit(0).write.mode("overwrite").parquet(f"{path}/date={row['date'].isoformat()}")

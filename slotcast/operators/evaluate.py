"""Scores at 15-minute, hourly and daily grain.

Errors are added up slot to hour to day to series, so each level shuffles only
the already reduced rows of the level below, and one scan serves all grains.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.calendar import hour_start
from slotcast.functions.scalars import abs_error, safe_ratio
from slotcast.operators.median import column_medians
from slotcast.schemas import KEYS

GRAINS = ["15min", "hourly", "daily"]
# Fixed value: improvement in percent that counts as success.
TARGET_IMPROVEMENT = 20.0


def with_abs_error(predictions: DataFrame, yhat: str = "yhat", name: str = "ae") -> DataFrame:
    return predictions.withColumn(name, abs_error(F.col("y"), F.col(yhat)))


def series_mae(predictions: DataFrame, yhat: str = "yhat", keys: list[str] = KEYS) -> DataFrame:
    """Mean absolute error per series, slot by slot."""
    error = abs_error(F.col("y"), F.col(yhat))
    return predictions.groupBy(*keys).agg(F.avg(error).alias("mae_15min"))


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def hourly_totals(predictions: DataFrame, yhat: str = "yhat", keys: list[str] = KEYS) -> DataFrame:
    error = abs_error(F.col("y"), F.col(yhat))
    return predictions.groupBy(*keys, hour_start(F.col("ds")).alias("hour")).agg(
        _total("y").alias("y"),
        _total(yhat).alias("yhat"),
        F.sum(error).alias("slot_error"),
        F.count(error).alias("slots"),
    )


def daily_totals(hourly: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return hourly.groupBy(*keys, F.to_date("hour").alias("date")).agg(
        F.sum("y").alias("y"),
        F.sum("yhat").alias("yhat"),
        F.sum("slot_error").alias("slot_error"),
        F.sum("slots").alias("slots"),
        F.sum(abs_error(F.col("y"), F.col("yhat"))).alias("hour_error"),
        F.count(F.lit(1)).alias("hours"),
    )


def series_scores(
    predictions: DataFrame, yhat: str = "yhat", keys: list[str] = KEYS
) -> DataFrame:
    """Per series the mean absolute error of slots, of hourly and of daily totals."""
    daily = daily_totals(hourly_totals(predictions, yhat, keys), keys)
    return daily.groupBy(*keys).agg(
        F.try_divide(F.sum("slot_error"), F.sum("slots")).alias("mae_15min"),
        (F.sum("hour_error") / F.sum("hours")).alias("mae_hourly"),
        F.avg(abs_error(F.col("y"), F.col("yhat"))).alias("mae_daily"),
    )


def median_scores(scores: DataFrame) -> DataFrame:
    """Median over series per grain and their mean, as rows ``(grain, mae)``."""
    medians = column_medians(scores, [f"mae_{g}" for g in GRAINS])
    medians = medians.select(*[F.col(f"mae_{g}").alias(g) for g in GRAINS])
    combined = (F.col("15min") + F.col("hourly") + F.col("daily")) / 3
    wide = medians.withColumn("combined", combined)
    return wide.unpivot([], [*GRAINS, "combined"], "grain", "mae")


def evaluate(predictions: DataFrame, yhat: str = "yhat", keys: list[str] = KEYS) -> DataFrame:
    return median_scores(series_scores(predictions, yhat, keys))


def improvement(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """Per grain how much smaller the error became, in percent of the baseline."""
    base, new = F.col("baseline_mae"), F.col("model_mae")
    return (
        baseline.withColumnRenamed("mae", "baseline_mae")
        .join(other.withColumnRenamed("mae", "model_mae"), "grain")
        .withColumn("improvement_pct", F.try_divide(base - new, base) * 100)
    )


def comparison_report(baseline: DataFrame, other: DataFrame) -> DataFrame:
    met = F.coalesce(F.col("improvement_pct") >= TARGET_IMPROVEMENT, F.lit(False))
    return improvement(baseline, other).withColumn("target_met", met.cast("int"))


def location_improvement(predictions: DataFrame, baseline: str, model: str) -> DataFrame:
    """Improvement per location, each of its series weighing the same."""
    y = F.col("y")
    per_series = predictions.groupBy(*KEYS).agg(
        F.avg(abs_error(y, F.col(baseline))).alias("base"),
        F.avg(abs_error(y, F.col(model))).alias("new"),
    )
    pct = F.when(F.col("base") > 0, (F.col("base") - F.col("new")) / F.col("base") * 100)
    return (
        per_series.groupBy("location_id")
        .agg(F.avg("base").alias("base"), F.avg("new").alias("new"))
        .select("location_id", F.coalesce(pct, F.lit(0.0)).alias("improvement_pct"))
    )


def zero_metrics(predictions: DataFrame, predictors: list[str]) -> DataFrame:
    """Precision and recall of predicting a zero, per predictor; 0 without any zero."""
    actual = F.col("y") == 0
    counts = [F.count_if(actual).alias("actual")]
    for p in predictors:
        predicted = F.col(p) == 0
        counts += [
            F.count_if(predicted).alias(f"{p}_predicted"),
            F.count_if(actual & predicted).alias(f"{p}_hits"),
        ]
    per_predictor = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("predictor"),
                    F.col("actual").alias("actual_zeros"),
                    F.col(f"{p}_predicted").alias("predicted_zeros"),
                    F.col(f"{p}_hits").alias("zero_hits"),
                )
                for p in predictors
            ]
        )
    )
    rows = predictions.agg(*counts).select(per_predictor.alias("r")).select("r.*")
    hits = F.col("zero_hits")
    return rows.withColumns(
        {
            "precision": safe_ratio(hits, F.col("predicted_zeros")),
            "recall": safe_ratio(hits, F.col("actual_zeros")),
        }
    )

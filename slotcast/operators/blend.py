"""Post-processing and blending of two predictions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.scalars import abs_error, is_zero
from slotcast.operators.median import column_medians
from slotcast.operators.profile import with_zero_rate
from slotcast.schemas import KEYS

# Fixed values of post-processing and blending.
MAX_ZERO_RATE = 0.9
SMALLEST_PREDICTION = 0.5
QUIET_SERIES_ZERO_RATE = 0.7
QUIET_SERIES_SMALLEST = 1.0
EVALUATION_BASELINE_WEIGHT = 0.15
PRODUCTION_BASELINE_WEIGHT = 0.2
BOTH_SMALL = 1
BASELINE_SMALL = 2
SEARCH_WEIGHTS = [0.1, 0.2, 0.3, 0.4, 0.5]
DEFAULT_WEIGHT = 0.3


def clean_prediction(yhat: Column, series_zero_rate: Column | None = None) -> Column:
    """A raw prediction cleared where the slot is usually closed or the value is tiny.

    Reads ``typical_open`` and ``interval_zero_rate``. ``series_zero_rate`` adds the
    stricter rule for series that are mostly zero.
    """
    smallest: Column = F.lit(SMALLEST_PREDICTION)
    if series_zero_rate is not None:
        quiet = series_zero_rate > QUIET_SERIES_ZERO_RATE
        smallest = F.when(quiet, F.lit(QUIET_SERIES_SMALLEST)).otherwise(smallest)
    closed = (F.col("typical_open") == 0) | F.coalesce(
        F.col("interval_zero_rate") > MAX_ZERO_RATE, F.lit(False)
    )
    return F.when(closed | (yhat < smallest), F.lit(0.0)).otherwise(yhat)


def post_process(
    predictions: DataFrame, yhat: str, quiet_rule: bool = True, zero_rate: str | None = None
) -> DataFrame:
    """Replace ``yhat`` by its cleaned value.

    The quiet-series rule takes the zero rate of the rows given, or of the column
    ``zero_rate`` where the scored actuals must not be looked at.
    """
    if not quiet_rule:
        return predictions.withColumn(yhat, clean_prediction(F.col(yhat)))
    if zero_rate is not None:
        return predictions.withColumn(yhat, clean_prediction(F.col(yhat), F.col(zero_rate)))
    rated = with_zero_rate(predictions, "_zero_rate")
    return rated.withColumn(yhat, clean_prediction(F.col(yhat), F.col("_zero_rate"))).drop(
        "_zero_rate"
    )


def pair_predictions(baseline: DataFrame, model: DataFrame, model_yhat: str) -> DataFrame:
    """Rows both models predicted."""
    return baseline.join(model.select("ds", *KEYS, model_yhat), ["ds", *KEYS])


def blended(
    baseline: Column, model: Column, weight: float, model_zero_rule: bool = True
) -> Column:
    """Weighted mean, cleared where both predictions are small.

    ``model_zero_rule`` also clears it where the model predicts zero and the
    baseline little.
    """
    clear = (baseline < BOTH_SMALL) & (model < BOTH_SMALL)
    if model_zero_rule:
        clear = clear | ((model == 0) & (baseline < BASELINE_SMALL))
    return F.when(clear, F.lit(0.0)).otherwise(weight * baseline + (1 - weight) * model)


def evaluation_blend(pairs: DataFrame, baseline: str = "yhat", model: str = "yhat_b") -> DataFrame:
    value = blended(F.col(baseline), F.col(model), EVALUATION_BASELINE_WEIGHT)
    return pairs.withColumn("yhat_final", value)


def production_blend(pairs: DataFrame, baseline: str = "yhat", model: str = "yhat_b") -> DataFrame:
    value = blended(F.col(baseline), F.col(model), PRODUCTION_BASELINE_WEIGHT, False)
    return pairs.withColumn("yhat_final", value)


def blend_or_baseline(baseline: DataFrame, model: DataFrame, model_yhat: str) -> DataFrame:
    """Production blend where the model has a prediction, else the baseline alone."""
    rows = baseline.join(model.select("ds", *KEYS, model_yhat), ["ds", *KEYS], "left")
    modelled = F.col(model_yhat).isNotNull()
    mixed = blended(F.col("yhat"), F.col(model_yhat), PRODUCTION_BASELINE_WEIGHT, False)
    return rows.withColumn("yhat_final", F.when(modelled, mixed).otherwise(F.col("yhat")))


def zero_hits(pairs: DataFrame, predictors: list[str]) -> DataFrame:
    """Zero actuals, and how many of them each predictor hits."""
    actual = is_zero(F.col("y"))
    hits = [F.sum(actual * is_zero(F.col(p))).alias(f"{p}_hits") for p in predictors]
    return pairs.agg(F.sum(actual).alias("actual_zeros"), *hits)


def weight_scores(
    pairs: DataFrame,
    baseline: str = "yhat",
    model: str = "yhat_b",
    weights: list[float] = SEARCH_WEIGHTS,
) -> DataFrame:
    """Median over series of the error at each weight, as rows ``(weight, mae)``.

    All weights are scored in one pass, one column each, without copying rows.
    """
    names = {f"w{i}": w for i, w in enumerate(weights)}

    def error(weight: float) -> Column:
        return abs_error(F.col("y"), weight * F.col(baseline) + (1 - weight) * F.col(model))

    per_series = pairs.groupBy(*KEYS).agg(*[F.avg(error(w)).alias(n) for n, w in names.items()])
    medians = column_medians(per_series, list(names))
    rows = F.array(
        *[F.struct(F.lit(w).alias("weight"), F.col(n).alias("mae")) for n, w in names.items()]
    )
    return medians.select(F.explode(rows).alias("r")).select("r.*")


def best_weight(scores: DataFrame, default: float = DEFAULT_WEIGHT) -> DataFrame:
    """The weight with the smallest error, the smaller weight on a tie, as one row."""
    usable = F.col("mae").isNotNull() & ~F.isnan("mae")
    best = F.min(F.when(usable, F.struct("mae", "weight")))
    return scores.agg(best.alias("best")).select(
        F.coalesce("best.weight", F.lit(default)).alias("weight"), F.col("best.mae").alias("mae")
    )


def search_blend(pairs: DataFrame, baseline: str = "yhat", model: str = "yhat_b") -> DataFrame:
    """Pairs blended at their best weight, which is one row and therefore broadcast."""
    weight = best_weight(weight_scores(pairs, baseline, model)).select("weight")
    value = F.col("weight") * F.col(baseline) + (1 - F.col("weight")) * F.col(model)
    return pairs.crossJoin(F.broadcast(weight)).withColumn("yhat_final", value)

"""Evaluation runs: baseline, boosted trees, blend and comparison."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.operators import blend, boosted
from slotcast.operators.baseline import baseline_forecast
from slotcast.operators.clean import long_enough, without_warmup
from slotcast.operators.evaluate import comparison_report, evaluate
from slotcast.operators.features import evaluation_features, feature_matrix
from slotcast.operators.holidays import holiday_labels
from slotcast.operators.profile import series_profile
from slotcast.operators.ridge import ridge_forecast
from slotcast.operators.windows import with_split
from slotcast.plans.panel import Tables, panel_of
from slotcast.schemas import KEYS
from slotcast.sources.storage import materialize


@dataclass(frozen=True)
class Limits:
    """Shortest series, training part and test part that are fitted."""

    min_rows: int = 100
    min_train: int = 50
    min_test: int = 10
    min_tree_rows: int = boosted.MIN_ROWS


def baseline_predictions(
    tables: Tables, limits: Limits = Limits(), model: str = "index"
) -> DataFrame:
    """Held-out predictions of the ``index`` or the ``ridge`` baseline."""
    fit = {"index": baseline_forecast, "ridge": ridge_forecast}[model]
    labels = holiday_labels(tables.holiday, tables.location)
    return fit(
        panel_of(tables.sales),
        labels,
        min_rows=limits.min_rows,
        min_train=limits.min_train,
        min_test=limits.min_test,
    )


def baseline_scores(tables: Tables, limits: Limits = Limits(), model: str = "index") -> DataFrame:
    return evaluate(baseline_predictions(tables, limits, model))


def tree_predictions(
    tables: Tables,
    limits: Limits = Limits(),
    params: boosted.TreeParams = boosted.EVALUATION_PARAMS,
    keep_warmup: bool = False,
) -> DataFrame:
    """Cleaned held-out predictions ``(ds, keys, y, yhat_b)`` of the tree model.

    Profiles, validation rows and the quiet-series rule come from training rows
    only. The prepared matrix is written once: training passes over it many times.
    Without a long enough series there is nothing to train and no prediction.
    """
    matrix = feature_matrix(
        with_split(panel_of(tables.sales)),
        tables.location,
        tables.weather,
        tables.holiday,
        train_only="is_train",
    )
    # Series count as long enough by the rows left to train on. The matrix is written before
    # its medians are taken.
    matrix = long_enough(without_warmup(matrix, keep=keep_warmup), limits.min_tree_rows)
    rows, names = evaluation_features(materialize(matrix, "matrix"), keep_warmup=True)
    rows = materialize(rows, "features")
    if rows.isEmpty():
        return rows.select("ds", *KEYS, "y", F.lit(None).cast("double").alias("yhat_b"))
    train = boosted.with_validation(rows.filter("is_train"))
    model = boosted.fit_trees(train, names, params)
    test = boosted.predict_trees(model, rows.filter("NOT is_train"), names)
    rates = series_profile(rows.filter("is_train")).select(*KEYS, "y_zero_rate")
    cleaned = blend.post_process(test.join(rates, KEYS, "left"), "yhat_b", zero_rate="y_zero_rate")
    return cleaned.select("ds", *KEYS, "y", "yhat_b")


def blended_predictions(baseline: DataFrame, trees: DataFrame) -> DataFrame:
    return blend.evaluation_blend(blend.pair_predictions(baseline, trees, "yhat_b"))


def compare(baseline: DataFrame, trees: DataFrame) -> DataFrame:
    """Scores of the baseline against the fixed blend, one row per grain."""
    final = blended_predictions(baseline, trees)
    return comparison_report(evaluate(baseline), evaluate(final, "yhat_final"))


def compare_best_weight(baseline: DataFrame, trees: DataFrame) -> DataFrame:
    """Scores of the baseline against the best weighted mean, with the weight."""
    pairs = materialize(blend.pair_predictions(baseline, trees, "yhat_b"), "pairs")
    best = blend.best_weight(blend.weight_scores(pairs)).select(F.col("weight"))
    final = blend.search_blend(pairs)
    report = comparison_report(evaluate(pairs), evaluate(final, "yhat_final"))
    return report.crossJoin(F.broadcast(best))

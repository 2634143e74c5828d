"""Seasonal regression per series.

Model: a trend with changepoints, plus yearly, weekly and daily Fourier terms and
optional regressors scaled by the straight trend line, which makes them
multiplicative, times a holiday factor. Ridge penalties act as normal priors; those of the
changepoints are reweighted until they act as Laplace priors, which leave few bends.

Each month of a series is reduced to its Gram matrix; adding the months up gives the
normal equations of the series, and only those, a few kilobytes per month, meet in the
solving task. No Python task holds a whole series; the scaling before it does use
windows over one, at most 96 rows a day.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.operators.baseline import with_holiday_factor, with_seasonal_index, with_trend
from slotcast.operators.clean import long_enough
from slotcast.operators.gapfill import future_slots
from slotcast.operators.holidays import with_holiday_label
from slotcast.operators.windows import TRAIN_SHARE, with_enough_history, with_split
from slotcast.schemas import KEYS, SLOTS_PER_DAY
from slotcast.sources.storage import materialize

# Fixed values of the model: Fourier order per period in days, changepoints over the
# first part of the history, penalty scales and interval width.
PERIODS = {365.25: 10, 7.0: 3, 1.0: 4}
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
TREND_SCALE = 5.0
CHANGEPOINT_SCALE = 0.05
SEASONALITY_SCALE = 10.0
INTERVAL_Z = 1.96
# Rounds of estimating the residual variance, which sets the strength of the priors, and of
# reweighting the changepoints' priors by the bends found.
VARIANCE_STEPS = 4
BEND_STEPS = 30
# Bends below this share of the series' level are none.
LEAST_BEND = 1e-6

_KEY_SCHEMA = ", ".join(f"{k} long" for k in KEYS)
_PERIOD = "period"


def _trend_matrix(x: np.ndarray, span: np.ndarray) -> np.ndarray:
    scaled = x / span
    knots = np.linspace(0, CHANGEPOINT_RANGE, CHANGEPOINTS + 1)[1:]
    bends = np.maximum(scaled[:, None] - knots[None, :], 0.0)
    return np.column_stack([np.ones_like(scaled), scaled, bends])


def _seasonal_matrix(day: np.ndarray) -> np.ndarray:
    columns = []
    for period, order in PERIODS.items():
        for n in range(1, order + 1):
            angle = 2 * np.pi * n * day / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


def _design(pdf: pd.DataFrame, regressors: list[str]) -> np.ndarray:
    """One row per timestamp; multiplicative parts carry the trend line as a factor."""
    line = pdf["trend"].to_numpy()[:, None]
    seasonal = [_seasonal_matrix(pdf["day"].to_numpy())]
    if regressors:
        seasonal.append(pdf[regressors].to_numpy())
    trend = _trend_matrix(pdf["x"].to_numpy(), pdf["span"].to_numpy())
    return np.column_stack([trend, line * np.column_stack(seasonal)])


def _prior_deviation(size: int, level: float, span: float) -> np.ndarray:
    """Prior standard deviation of each coefficient.

    A period the history does not cover in full is shrunk, as its terms would
    otherwise be free to bend in any direction beyond the history.
    """
    trend = np.full(2 + CHANGEPOINTS, CHANGEPOINT_SCALE * level)
    trend[:2] = TREND_SCALE * level
    seasonal = [
        np.full(2 * order, SEASONALITY_SCALE * min(1.0, span / period) ** 2)
        for period, order in PERIODS.items()
    ]
    known = np.concatenate([trend, *seasonal])
    return np.concatenate([known, np.full(size - len(known), SEASONALITY_SCALE)])


def prepare(split: DataFrame, regressors: list[str]) -> DataFrame:
    """Time axes, holiday factor and gap-free regressors of split series.

    A missing regressor value takes the median of its series' training rows, and so
    does every row to predict. Regressors are centred and scaled per series. The
    holiday factor is 1 unless the rows carry a ``holiday_label``.
    """
    series = Window.partitionBy(*KEYS)
    df = with_trend(split)
    last_train = F.max(F.when(F.col("is_train"), F.col("x"))).over(series)
    minutes = F.hour("ds") * 60 + F.minute("ds")
    month = F.year("ds") * 12 + F.month("ds")
    df = df.withColumns(
        {
            "span": F.greatest(last_train, F.lit(1.0 / SLOTS_PER_DAY)),
            "day": F.unix_date(F.to_date("ds")) + minutes / (24 * 60),
            _PERIOD: month,
            "last_period": F.max(month).over(series),
        }
    )
    for name in regressors:
        known = F.when(F.col("is_train"), F.col(name))
        median = F.median(known).over(series)
        off_median = F.coalesce(known, median) - median
        spread = F.stddev_samp(known).over(series)
        df = df.withColumn(name, F.coalesce(F.try_divide(off_median, spread), F.lit(0.0)))
    if "holiday_label" not in df.columns:
        return df.withColumn("holiday_factor", F.lit(1.0))
    return with_holiday_factor(with_seasonal_index(df))


def _gram(regressors: list[str]):
    def reduce_month(pdf: pd.DataFrame) -> pd.DataFrame:
        design = _design(pdf, regressors)
        y = pdf["target"].to_numpy()
        out = pdf[KEYS].head(1).copy()
        out["xx"] = [(design.T @ design).tobytes()]
        out["xy"] = [(design.T @ y).tobytes()]
        out["yy"] = [float(y @ y)]
        out["n"] = [len(y)]
        for name in ("span", _PERIOD, "last_period"):
            out[name] = pdf[name].iloc[0]
        return out

    return reduce_month


def _reweighted(
    xx: np.ndarray, xy: np.ndarray, prior: np.ndarray, variance: float, level: float
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and priors once the changepoints' penalties are those of Laplace priors.

    A normal prior of variance ``scale * |bend|`` has the same slope at the bend as a Laplace prior
    of that scale. Bends that explain little shrink from round to round, and free their share
    for the others. Only the normal equations are solved anew.
    """
    prior = prior.copy()
    bends = slice(2, 2 + CHANGEPOINTS)
    scale = prior[bends].copy()
    beta = np.linalg.solve(xx + np.diag(variance / prior**2), xy)
    for _ in range(BEND_STEPS):
        prior[bends] = np.sqrt(scale * np.maximum(np.abs(beta[bends]), LEAST_BEND * level))
        beta = np.linalg.solve(xx + np.diag(variance / prior**2), xy)
    return beta, prior


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ridge solution from the added-up months, its strength set by the residual variance.

    Its months run from the first with training rows to the last of the series. ``factor`` is
    the triangular root of the coefficients' covariance, ``drift`` the variance that trend
    changes yet to come add at one span beyond the history.
    """
    xy = sum(np.frombuffer(b) for b in pdf["xy"])
    xx = sum(np.frombuffer(b) for b in pdf["xx"]).reshape(len(xy), len(xy))
    yy, n = pdf["yy"].sum(), pdf["n"].sum()
    level = max(float(np.sqrt(yy / n)), 1e-9)
    prior = _prior_deviation(len(xy), level, pdf["span"].max())
    variance = level**2
    for _ in range(VARIANCE_STEPS):
        beta = np.linalg.solve(xx + np.diag(variance / prior**2), xy)
        squares = yy - 2 * beta @ xy + beta @ xx @ beta
        variance = max(squares / n, (1e-6 * level) ** 2)
    beta, prior = _reweighted(xx, xy, prior, variance, level)
    squares = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
    inverse = np.linalg.inv(xx + np.diag(variance / prior**2))
    # Each coefficient that the data decide takes one residual away.
    free = max(n - float(np.trace(inverse @ xx)), 1.0)
    noise = max(squares / free, (1e-6 * level) ** 2)
    covariance = noise * (inverse + inverse.T) / 2
    values, vectors = np.linalg.eigh(covariance)
    root = np.linalg.qr((vectors * np.sqrt(np.maximum(values, 0.0))).T, mode="r")
    # Changes come as often as changepoints stand in the history, and are as large as their mean.
    size = float(np.abs(beta[2 : 2 + CHANGEPOINTS]).mean())
    out = pdf[KEYS].head(1).copy()
    out["periods"] = [np.arange(pdf[_PERIOD].min(), pdf["last_period"].iloc[0] + 1)]
    out["last_train"] = [pdf[_PERIOD].max()]
    out["coefficients"] = [beta]
    out["sigma"] = [float(np.sqrt(noise))]
    out["factor"] = [root[np.triu_indices(len(xy))].astype(np.float32).tobytes()]
    out["drift"] = [2 * size**2 * CHANGEPOINTS / CHANGEPOINT_RANGE / 3]
    return out


def fit(prepared: DataFrame, regressors: list[str]) -> DataFrame:
    """Coefficients, residual deviation and months per series."""
    target = F.coalesce(F.try_divide(F.col("y"), F.col("holiday_factor")), F.col("y"))
    train = prepared.filter("is_train AND y IS NOT NULL").select(
        *KEYS, _PERIOD, "last_period", "x", "span", "day", "trend", *regressors,
        target.alias("target"),
    )
    months = train.groupBy(*KEYS, _PERIOD).applyInPandas(
        _gram(regressors),
        f"{_KEY_SCHEMA}, xx binary, xy binary, yy double, n long, span double, "
        f"{_PERIOD} int, last_period int",
    )
    return months.groupBy(*KEYS).applyInPandas(
        _solve,
        f"{_KEY_SCHEMA}, periods array<int>, last_train int, "
        "coefficients array<double>, sigma double, factor binary, drift double",
    )


def _deviation(design: np.ndarray, ahead: np.ndarray, model: pd.Series) -> np.ndarray:
    """Standard deviation of new values: noise, coefficients, and trend changes ahead.

    ``ahead`` is how many spans of the history a row lies beyond it. A change at ``u`` moves the trend
    at ``h`` by its size times ``h - u``, so all changes add up to a variance of ``drift * h^3``.
    """
    size = design.shape[1]
    root = np.zeros((size, size))
    root[np.triu_indices(size)] = np.frombuffer(model["factor"], np.float32)
    own = ((design @ root.T) ** 2).sum(axis=1)
    later = model["drift"] * np.maximum(ahead, 0.0) ** 3
    return np.sqrt(model["sigma"] ** 2 + own + later)


def _predict(regressors: list[str]):
    def predict_month(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*KEYS, "ds", "y"]].copy()
        if rows.empty or model.empty:
            return out.head(0).assign(yhat=[], yhat_lower=[], yhat_upper=[])
        factor = rows["holiday_factor"].to_numpy()
        design = _design(rows, regressors)
        out["yhat"] = design @ np.asarray(model["coefficients"].iloc[0]) * factor
        ahead = rows["x"].to_numpy() / rows["span"].to_numpy() - 1
        margin = INTERVAL_Z * np.abs(factor) * _deviation(design, ahead, model.iloc[0])
        out["yhat_lower"] = out["yhat"] - margin
        out["yhat_upper"] = out["yhat"] + margin
        return out

    return predict_month


def predict(
    prepared: DataFrame, models: DataFrame, regressors: list[str], with_train: bool = False
) -> DataFrame:
    """Predictions of the rows held out, or of all rows."""
    months = models.withColumn(_PERIOD, F.explode("periods"))
    if not with_train:
        prepared = prepared.filter(~F.col("is_train"))
        months = months.filter(F.col(_PERIOD) >= F.col("last_train"))
    months = months.drop("periods", "last_train")
    rows = prepared.select(
        *KEYS, _PERIOD, "ds", "y", "x", "span", "day", "trend", "holiday_factor", *regressors
    )
    # Renaming gives the two sides, which share a lineage, columns of their own.
    months = months.toDF(*months.columns)
    by_month = [*KEYS, _PERIOD]
    return (
        rows.groupBy(*by_month)
        .cogroup(months.groupBy(*by_month))
        .applyInPandas(
            _predict(regressors),
            f"{_KEY_SCHEMA}, ds timestamp_ntz, y double, "
            "yhat double, yhat_lower double, yhat_upper double",
        )
    )


def ridge_forecast(
    panel: DataFrame,
    labels: DataFrame | None = None,
    regressors: Sequence[str] = (),
    min_rows: int = 100,
    min_train: int = 50,
    min_test: int = 10,
) -> DataFrame:
    """Predictions with 95% interval for the held-out end of each long enough series.

    The interval holds the residuals' variance, that of the fitted coefficients at the row, and that of
    trend changes after the history, so it widens with the horizon.
    """
    names = list(regressors)
    split = with_split(panel if labels is None else with_holiday_label(panel, labels))
    # Fitting and prediction both read it.
    prepared = prepare(with_enough_history(split, min_rows, min_train, min_test), names)
    prepared = materialize(prepared, "prepared")
    return predict(prepared, fit(prepared, names), names)


def ridge_future(
    history: DataFrame,
    days: int,
    labels: DataFrame | None = None,
    regressors: Sequence[str] = (),
    min_rows: int = 100,
    with_history: bool = False,
) -> DataFrame:
    """Fit on all of each long enough series and predict the ``days`` after it.

    ``with_history`` predicts the timestamps of the history as well.
    """
    names = list(regressors)
    known = long_enough(history, min_rows).withColumn("is_train", F.lit(True))
    ahead = future_slots(known, days).withColumn("is_train", F.lit(False))
    both = known.select("ds", *KEYS, "y", "is_train", *names).unionByName(
        ahead, allowMissingColumns=True
    )
    if labels is not None:
        both = with_holiday_label(both, labels)
    prepared = materialize(prepare(both, names), "prepared")
    return predict(prepared, fit(prepared, names), names, with_history).drop("y")


def fit_status(
    panel: DataFrame, min_rows: int = 100, min_train: int = 50, min_test: int = 10
) -> DataFrame:
    """Per series whether it is long enough to be fitted, so no series vanishes silently."""
    sizes = panel.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
    train = F.floor(F.col("n_rows") * F.lit(TRAIN_SHARE))
    enough = (
        (F.col("n_rows") >= min_rows)
        & (train >= min_train)
        & (F.col("n_rows") - train >= min_test)
    )
    status = F.when(enough, F.lit("fitted")).otherwise(F.lit("too_short"))
    return sizes.withColumn("status", status)

"""Changepoints and intervals of the seasonal regression."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slotcast.operators import ridge
from slotcast.operators.ridge import ridge_forecast, ridge_future

START = pd.Timestamp("2024-01-01")
PANEL = "ds timestamp_ntz, location_id long, sales_type_id long, department_id long, y double"


def made(series, days, trend, noise, seed=0):
    rng = np.random.default_rng(seed)
    slot = np.arange(days * 96)
    parts = []
    for s in range(series):
        season = 1 + 0.3 * np.sin(2 * np.pi * slot / 96)
        y = trend(slot / len(slot)) * season + noise * rng.normal(size=len(slot))
        keys = {"location_id": s, "sales_type_id": 1, "department_id": 0}
        parts.append(pd.DataFrame({"ds": START + pd.to_timedelta(15 * slot, unit="min"), **keys, "y": y}))
    return pd.concat(parts, ignore_index=True)


def bends_of(spark, frame):
    rows = spark.createDataFrame(frame, PANEL).withColumn("is_train", F.lit(True))
    models = ridge.fit(ridge.prepare(rows, []), []).collect()
    return [np.array(m["coefficients"])[2 : 2 + ridge.CHANGEPOINTS] for m in models]


def test_one_planted_bend_is_found(spark):
    knot = np.linspace(0, ridge.CHANGEPOINT_RANGE, ridge.CHANGEPOINTS + 1)[1:][11]
    frame = made(1, 60, lambda t: 100 + 40 * t - 120 * np.maximum(t - knot, 0), 3.0)
    (bends,) = bends_of(spark, frame)
    near = np.abs(np.arange(ridge.CHANGEPOINTS) - 11) <= 1
    assert np.abs(bends[near]).sum() > 60 and bends[near].sum() < 0
    assert np.abs(bends[~near]).max() < 0.05 * np.abs(bends[near]).sum()


def test_a_straight_line_has_no_bends(spark):
    (bends,) = bends_of(spark, made(1, 60, lambda t: 100 + 40 * t, 3.0))
    assert np.abs(bends).max() < 2


def test_intervals_hold_their_share_of_values(spark):
    frame = made(8, 40, lambda t: 100 + 20 * t, 5.0, seed=3)
    rows = ridge_forecast(spark.createDataFrame(frame, PANEL)).toPandas()
    inside = ((rows.y >= rows.yhat_lower) & (rows.y <= rows.yhat_upper)).mean()
    assert 0.93 <= inside <= 0.97
    width = rows.yhat_upper - rows.yhat_lower
    assert (width > 2 * 1.9 * 5.0 * 0.95).all()


def test_intervals_widen_with_the_horizon(spark):
    frame = made(2, 40, lambda t: 100 + 60 * np.maximum(t - 0.5, 0), 2.0)
    rows = ridge_future(spark.createDataFrame(frame, PANEL), 40).toPandas()
    rows["width"] = rows.yhat_upper - rows.yhat_lower
    rows["week"] = (rows.ds - rows.ds.min()).dt.days // 7
    for _, own in rows.groupby("location_id"):
        by_week = own.groupby("week").width.mean().to_numpy()
        assert (np.diff(by_week) > 0).all() and by_week[-1] > 1.2 * by_week[0]

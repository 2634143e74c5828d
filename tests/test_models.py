import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotcast import schemas
from slotcast.functions.calendar import moment
from slotcast.operators import boosted, features
from slotcast.operators.baseline import baseline_forecast
from slotcast.operators.evaluate import series_mae
from slotcast.operators.ridge import fit_status, ridge_forecast, ridge_future
from slotcast.plans import evaluation, production
from slotcast.plans.panel import Tables, panel_of
from slotcast.schemas import KEYS
from slotcast.sources import snapshots

START = pd.Timestamp("2024-01-01")
TREES = boosted.TreeParams(max_iter=2, max_depth=2)
PANEL = "ds timestamp_ntz, location_id long, sales_type_id long, department_id long, y double"


def seasonal_frame(days=28, series=2, noise=0.0, seed=0) -> pd.DataFrame:
    """Trend times daily and weekly season, closed at night."""
    rng = np.random.default_rng(seed)
    slot = np.arange(days * 96)
    hour = slot % 96 / 4
    day = slot // 96
    parts = []
    for s in range(series):
        level = (50 + 10 * s) * (1 + 0.01 * slot / 96)
        season = (1 + 0.4 * np.sin(2 * np.pi * hour / 24)) * (1 + 0.2 * (day % 7 >= 5))
        y = level * season * (1 + noise * rng.normal(size=len(slot)))
        y = np.where(hour < 6, 0.0, y)
        parts.append(
            pd.DataFrame(
                {
                    "ds": START + pd.to_timedelta(15 * slot, unit="min"),
                    "location_id": s,
                    "sales_type_id": 10 * s + 1,
                    "department_id": 0,
                    "y": y,
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(seasonal_frame(noise=0.02), PANEL).cache()


@pytest.fixture(scope="module")
def side_tables(spark):
    holiday = spark.createDataFrame([(0, dt.date(2024, 1, 10), "a", 0, 0)], schemas.HOLIDAY)
    location = spark.createDataFrame([(0, 0, "A"), (1, 1, "B")], schemas.LOCATION_CSV)
    hours = [START.to_pydatetime() + dt.timedelta(hours=h) for h in range(28 * 24)]
    weather = spark.createDataFrame(
        [(p, h, 10.0 + h.hour, 0.1, 0.0, 0.5) for h in hours for p in "AB"], schemas.WEATHER
    )
    return holiday, location, weather


def test_baseline_and_ridge_learn_the_season(spark, panel):
    flat = panel.groupBy(*KEYS).agg(F.avg("y").alias("yhat"))
    naive = series_mae(panel.join(flat, KEYS)).agg(F.max("mae_15min")).first()[0]
    for forecast, share in [(baseline_forecast(panel), 0.15), (ridge_forecast(panel), 0.5)]:
        assert forecast.count() == 2 * (28 * 96 - int(28 * 96 * 0.8))
        assert series_mae(forecast).agg(F.max("mae_15min")).first()[0] < share * naive


def test_baseline_without_series_windows_is_the_same(spark, panel):
    labels = spark.createDataFrame(
        [(0, dt.date(2024, 1, d), "a:0") for d in (5, 26)],
        "location_id long, date date, holiday_label string",
    )
    gaps = panel.withColumn("y", F.when(F.dayofmonth("ds") != 9, F.col("y")))
    for given in (None, labels):
        a = baseline_forecast(gaps, given)
        b = baseline_forecast(gaps, given, whole_series=False)
        both = a.join(b.withColumnRenamed("yhat", "other"), [*KEYS, "ds"])
        assert both.count() == a.count() == b.count()
        assert both.filter("abs(yhat - other) > 1e-6").isEmpty()


def test_panel_can_be_dense(spark, panel):
    sparse = panel.filter("y > 0")
    days = (dt.date(2024, 1, 1), dt.date(2024, 1, 28))
    assert panel_of(sparse).count() < panel_of(sparse, days).count() == 2 * 28 * 96


def test_ridge_fits_what_its_terms_can_say(spark):
    frame = seasonal_frame(series=1)
    hour = frame.ds.dt.hour + frame.ds.dt.minute / 60
    frame["y"] = 50 * (1 + 0.4 * np.sin(2 * np.pi * hour / 24))
    rows = ridge_forecast(spark.createDataFrame(frame, PANEL)).toPandas()
    assert (rows.y - rows.yhat).abs().mean() < 0.5
    assert ((rows.yhat_lower <= rows.yhat) & (rows.yhat <= rows.yhat_upper)).all()


def test_test_values_do_not_leak(spark, panel):
    split_at = START + pd.Timedelta(minutes=15 * int(28 * 96 * 0.8))
    late = F.col("ds") >= moment(split_at)
    changed = panel.withColumn("y", F.when(late, F.col("y") * 3 + 1).otherwise(F.col("y")))
    for fit in (baseline_forecast, ridge_forecast):
        a = fit(panel).select(*KEYS, "ds", F.round("yhat", 6).alias("yhat"))
        b = fit(changed).select(*KEYS, "ds", F.round("yhat", 6).alias("yhat"))
        assert a.exceptAll(b).isEmpty()


def test_holiday_factor_applies_to_its_label(spark, panel):
    days = [dt.date(2024, 1, d) for d in (5, 10, 15, 26)]
    labels = spark.createDataFrame(
        [(0, d, "a:0") for d in days], "location_id long, date date, holiday_label string"
    )
    on_day = F.to_date("ds").isin(days) & (F.col("location_id") == 0)
    busy = panel.withColumn("y", F.when(on_day, F.col("y") * 2).otherwise(F.col("y")))
    last = F.to_date("ds") == days[-1]
    plain = series_mae(baseline_forecast(busy).filter(last & on_day)).first().mae_15min
    aware = series_mae(baseline_forecast(busy, labels).filter(last & on_day)).first().mae_15min
    assert aware < 0.5 * plain


def test_short_series_are_reported_not_lost(spark, panel):
    short = panel.filter("location_id = 0").limit(60)
    both = panel.filter("location_id = 1").unionByName(short)
    status = {r.location_id: r.status for r in fit_status(both).collect()}
    assert status == {0: "too_short", 1: "fitted"}
    assert {r.location_id for r in ridge_forecast(both).select("location_id").collect()} == {1}


def test_ridge_with_regressor_gaps(spark, panel):
    gaps = panel.withColumn("real_feel", F.when(F.dayofmonth("ds") % 2 == 0, F.hour("ds") * 1.0))
    rows = ridge_forecast(gaps, regressors=["real_feel"])
    assert rows.filter("yhat IS NULL OR isnan(yhat)").isEmpty()


def test_ridge_future_horizon(spark, panel):
    future = ridge_future(panel, 3)
    span = future.groupBy("location_id").agg(F.min("ds"), F.max("ds"), F.count("*")).collect()
    first = (START + pd.Timedelta(days=28)).to_pydatetime()
    for _, low, high, n in span:
        assert (low, n) == (first, 3 * 96)
        assert high == first + dt.timedelta(minutes=15 * (3 * 96 - 1))


def test_ridge_can_predict_its_history(spark, panel):
    both = ridge_future(panel, 1, with_history=True)
    assert both.count() == both.select("ds", *KEYS).distinct().count() == 2 * 29 * 96
    later = both.filter(F.col("ds") >= moment(dt.date(2024, 1, 29)))
    alone = ridge_future(panel, 1)
    columns = [*KEYS, "ds", F.round("yhat", 6)]
    assert later.select(columns).exceptAll(alone.select(columns)).isEmpty()


def test_chunked_matrix_equals_whole(spark, panel, side_tables):
    holiday, location, weather = side_tables
    whole = features.feature_matrix(panel, location, weather, holiday)
    split = features.feature_matrix(panel, location, weather, holiday, chunk_rows=700)
    columns = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in whole.dtypes]
    assert whole.select(columns).exceptAll(split.select(columns)).isEmpty()


def test_feature_lists(spark, panel, side_tables):
    holiday, location, weather = side_tables
    assert len(features.EVALUATION_FEATURES) == 36 and len(features.PRODUCTION_FEATURES) == 31
    matrix = features.feature_matrix(panel, location, weather, holiday)
    rows, names = features.evaluation_features(matrix)
    assert names == features.EVALUATION_FEATURES
    # A week of rows per series has no full history.
    assert rows.count() == 2 * (28 * 96 - 672)
    assert features.evaluation_features(matrix, keep_warmup=True)[0].count() == 2 * 28 * 96
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    assert sum(nulls) == 0


def test_trees_predict_each_test_row_once(spark, panel, side_tables):
    holiday, location, weather = side_tables
    tables = Tables(panel, weather, holiday, location)
    got = evaluation.tree_predictions(tables, params=TREES).cache()
    assert got.count() == got.select("ds", *KEYS).distinct().count()
    assert got.count() == 2 * (28 * 96 - int(28 * 96 * 0.8))
    assert got.filter("yhat_b IS NULL OR yhat_b < 0").isEmpty()
    base = evaluation.baseline_predictions(tables)
    report = evaluation.compare_best_weight(base, got)
    assert {r.grain for r in report.collect()} == {"15min", "hourly", "daily", "combined"}


def test_no_long_series_means_no_trees(spark, panel, side_tables):
    holiday, location, weather = side_tables
    tables = Tables(panel, weather, holiday, location)
    limits = evaluation.Limits(min_tree_rows=10**6)
    assert evaluation.tree_predictions(tables, limits, TREES).count() == 0


def test_production_run_stores_and_publishes(spark, panel, side_tables, tmp_path):
    holiday, location, _ = side_tables
    store = production.Store(
        actual=panel.withColumn("department_id", F.lit(None).cast("long")),
        location=location,
        corporation=spark.createDataFrame([(0,), (1,)], "id long").withColumn(
            "start_time_interval", F.expr("INTERVAL '0' HOUR")
        ),
        department=spark.createDataFrame([], "id long, corporation_id long"),
        sales_type=spark.createDataFrame(
            [(1, 0, "L", True), (11, 1, "L", True)],
            "id long, corporation_id long, level string, forecast_enabled boolean",
        ),
        weather=spark.createDataFrame([], schemas.WEATHER_DAILY),
        holiday=holiday,
    )
    run_date = dt.date(2024, 1, 29)
    forecast = production.production_forecast(
        store, run_date, horizon_days=2, min_tree_rows=1000, params=TREES
    ).cache()
    assert forecast.count() == 2 * 2 * 96
    assert forecast.filter("yhat IS NULL").isEmpty()
    empty = spark.createDataFrame([], schemas.FORECAST)
    end = dt.date(2024, 1, 30)
    stored = production.store_forecast(empty, forecast, store, run_date, end)
    assert stored.count() == forecast.filter("yhat > 0").count()
    payload = production.publish(stored, store, run_date, end).collect()
    assert len(payload) == 4 and all(len(r.forecasts) == 96 for r in payload)

    # Run again as a whole, into a folder that isn't there yet, and once more.
    folder = str(tmp_path / "run")
    for number in (1, 2):
        version = production.run(store, run_date, folder, 2, min_tree_rows=1000, params=TREES)
        assert version == number
    again = snapshots.read_days(spark, f"{folder}/forecast", schemas.FORECAST)
    assert again.count() == stored.count()
    assert spark.read.text(f"{folder}/payload/{run_date}").count() == 4
    status = spark.read.parquet(f"{folder}/status/{run_date}").collect()
    assert {(r.location_id, r.n_rows, r.n_tree_rows, r.status) for r in status} == {
        (s, 28 * 96, 21 * 96, "blended") for s in (0, 1)
    }
    some = production.run_status(store, run_date, min_rows=28 * 96 + 1).collect()
    assert {r.status for r in some} == {"too_short"}
    some = production.run_status(store, run_date, min_tree_rows=21 * 96 + 1).collect()
    assert {r.status for r in some} == {"baseline"}
    none = production.run_status(store, dt.date(2030, 1, 1)).collect()
    assert {(r.n_rows, r.status) for r in none} == {(0, "no_history")}


def test_pandas_worker_sees_one_month_at_a_time(spark, panel):
    """The grouped fit is keyed by series and month, so no task gets a whole series."""
    plan = ridge_forecast(panel)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [location_id" in plan and "period" in plan

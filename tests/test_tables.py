import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import checks.tables  # noqa: F401
from checks.registry import QUERIES
from slotcast import schemas
from slotcast.operators import blend, clean, evaluate, gapfill, hierarchy, overwrite, publish
from slotcast.operators import holidays as hol
from slotcast.operators.median import column_medians, medians_by_column
from slotcast.plans.panel import load_csv_tables
from slotcast.schemas import KEYS
from slotcast.sources import readers, storage, writers

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
T1 = dt.datetime(2024, 1, 1)


def at(hours):
    return T1 + dt.timedelta(hours=hours)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# Cleaning


def test_duplicate_slot_keeps_smallest(sales):
    df = sales([(T1, 1, 10, 0, 5.0), (T1, 1, 10, 0, 3.0), (at(1), 1, 10, 0, 4.0)])
    assert rows_of(clean.first_per_slot(df), "ds", "y") == [(T1, 3.0), (at(1), 4.0)]


def test_missing_department_is_zero(sales):
    df = clean.fill_department(sales([(T1, 1, 10, None, 1.0), (T1, 1, 11, 7, 1.0)]))
    assert rows_of(df, "department_id") == [(0,), (7,)]


def test_sparse_forecast_drops_zero_negative_missing_nan(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (None,), (float("nan"),), (2.0,)], "yhat double")
    assert rows_of(clean.sparse_forecast(df), "yhat") == [(2.0,)]


def test_location_level_series_add_up_departments(spark, sales):
    types = spark.createDataFrame([(10, "L"), (11, "D")], "id long, level string")
    df = sales([(T1, 1, 10, 1, 2.0), (T1, 1, 10, 2, 3.0), (T1, 1, 11, 1, 2.0), (T1, 1, 11, 2, 3.0)])
    got = rows_of(clean.task_series(df, types), "sales_type_id", "department_id", "y")
    assert got == [(10, 0, 5.0), (11, 1, 2.0), (11, 2, 3.0)]


def test_warmup_is_dropped_only_before_filling(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "lag_672_15min double")
    assert clean.without_warmup(df).count() == 1
    assert clean.without_warmup(df, keep=True).count() == 2


def test_sample_takes_whole_series(spark):
    df = spark.range(2000).select(
        (F.col("id") % 200).alias("location_id"),
        F.lit(1).alias("sales_type_id"),
        F.lit(0).alias("department_id"),
    )
    taken = clean.sampled_series(df, 0.3, seed=1).groupBy("location_id").count().collect()
    assert {r["count"] for r in taken} == {10}
    assert 30 < len(taken) < 90
    assert clean.sampled_series(df, 1.0, seed=1).count() == 2000


def test_time_of_day_includes_both_ends(spark):
    rows = [(at(6),), (at(6) - dt.timedelta(microseconds=1),), (at(20),),
            (at(20) + dt.timedelta(microseconds=1),)]
    df = spark.createDataFrame(rows, "ds timestamp_ntz")
    assert rows_of(clean.time_of_day(df, 360, 1200), "ds") == [(at(6),), (at(20),)]


# Gap filling


def test_dense_slots_fill_and_keep(sales):
    df = gapfill.dense_slots(sales([(at(1), 1, 10, 0, 5.0)]), D1, D2)
    assert df.count() == 192
    assert rows_of(df.filter("y > 0"), "ds", "y") == [(at(1), 5.0)]


def test_series_outside_range_is_filled_with_zeros(sales):
    df = gapfill.dense_slots(sales([(at(24 * 9), 1, 10, 0, 5.0)]), D1, D1)
    assert df.count() == 96 and df.filter("y <> 0").count() == 0


def test_duplicate_slot_fails(sales):
    with pytest.raises(PySparkException):
        gapfill.dense_slots(sales([(T1, 1, 10, 0, 5.0), (T1, 1, 10, 0, 6.0)]), D1, D1).collect()


def test_future_slots_follow_each_series(sales):
    df = sales([(at(1), 1, 10, 0, 1.0), (at(5), 2, 10, 0, 1.0)])
    got = gapfill.future_slots(df, 1).groupBy("location_id").agg(F.min("ds"), F.max("ds"))
    quarter = dt.timedelta(minutes=15)
    assert rows_of(got, "*") == [
        (1, at(1) + quarter, at(25)),
        (2, at(5) + quarter, at(29)),
    ]


def test_missing_dates_and_coverage(spark):
    keys = spark.createDataFrame([("A",), ("B",)], "postal_code string")
    present = spark.createDataFrame([("A", D1)], "postal_code string, d date")
    missing = gapfill.missing_dates(keys, present, "d", D1, D2)
    assert rows_of(missing, "*") == [("A", D2), ("B", D1), ("B", D2)]
    coverage = gapfill.horizon_coverage(keys, present, "d", D1, 2)
    assert rows_of(coverage, "*") == [("A", 1, 1), ("B", 0, 1)]


# Holidays


def holidays(spark):
    return spark.createDataFrame(
        [(1, D1, "a", 1, 1), (1, D1, "b", 0, 0), (2, D2, "c", 0, 0)], schemas.HOLIDAY
    )


def locations(spark):
    return spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], schemas.LOCATION_CSV)


def test_two_holidays_on_a_date_do_not_duplicate_rows(spark, sales):
    df = sales([(T1, 1, 10, 0, 1.0), (T1, 2, 20, 0, 1.0)])
    own = hol.with_holiday_flag(df, hol.holiday_dates(holidays(spark), locations(spark)))
    assert rows_of(own, "location_id", "is_holiday") == [(1, 1), (2, 0)]
    anywhere = hol.with_holiday_flag(df, hol.holiday_dates(holidays(spark)))
    assert rows_of(anywhere, "location_id", "is_holiday") == [(1, 1), (2, 1)]


def test_holiday_windows_and_labels(spark):
    days = hol.holiday_days(holidays(spark)).filter("holiday = 'a'")
    before, after = dt.date(2023, 12, 31), D2
    assert rows_of(days, "date", "day_offset") == [(before, -1), (D1, 0), (after, 1)]
    labels = hol.holiday_labels(holidays(spark), locations(spark)).filter("location_id = 1")
    assert rows_of(labels, "date", "holiday_label") == [
        (before, "a:-1"), (D1, "a:0+b:0"), (after, "a:1"),
    ]


def test_location_of_two_corporations_is_flagged_once(spark, sales):
    """Repeated and null ids and corporations neither duplicate rows nor lose a date."""
    places = [(1, 1, "x"), (1, 2, "y"), (1, 1, "x"), (2, None, "y"), (3, 3, "z"), (None, 1, "n")]
    places = spark.createDataFrame(places, schemas.LOCATION_CSV)
    rows = [(at(24 * day), location, 10, 0, 1.0) for location in (1, 2, 9, None) for day in (0, 1, 2)]
    dates = hol.holiday_dates(holidays(spark), by_corporation=True)
    got = hol.with_holiday_flag(sales(rows), dates, places).na.fill(-1, ["location_id"])
    assert rows_of(got, "location_id", "ds", "is_holiday") == sorted(
        (-1 if location is None else location, at(24 * day), int(location == 1 and day < 2))
        for location in (1, 2, 9, None) for day in (0, 1, 2)
    )
    own = hol.holiday_dates(holidays(spark), places).na.fill(-1)
    assert rows_of(own, "location_id", "date") == [(-1, D1), (1, D1), (1, D2)]


def most_rows(df):
    """Rows that the largest step of the query puts out."""
    df.collect()
    steps, most = [df._jdf.queryExecution().executedPlan()], 0
    while steps:
        step = steps.pop()
        found = step.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        kind = step.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            steps.append(step.executedPlan())
        elif kind.endswith("QueryStageExec"):
            steps.append(step.plan())
        steps += [step.children().apply(i) for i in range(step.children().size())]
    return most


def test_future_holidays_make_no_dates_of_unneeded_locations(spark, tmp_path):
    """One location has a future of 17,280 slots, 20,000 share a corporation with 13 days."""
    key = (5 * F.col("id")).alias("c_custkey")
    customers = spark.range(20_000).select(key, F.lit(1).alias("c_nationkey"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    events = [(at(10), 1.0, "view", 5, '{"k": 1}')]
    columns = "ts timestamp_ntz, value double, event_type string, user_id long, props string"
    spark.createDataFrame(events, columns).write.parquet(f"{tmp_path}/events.parquet")
    future = QUERIES["j14_future_holidays"](spark, str(tmp_path))
    assert most_rows(future) <= 20_000
    # From 10:15 of the holiday, whose windows end two days later.
    assert rows_of(future.groupBy("is_holiday").count(), "*") == [(0, 17_280 - 247), (1, 247)]


# Range overwrite


def test_replace_matches_missing_department_and_is_idempotent(sales):
    table = sales([(T1, 1, 10, None, 1.0), (T1, 1, 11, 5, 1.0), (at(48), 1, 10, None, 9.0)])
    new = sales([(T1, 1, 10, None, 2.0)])
    once = overwrite.replace_actuals(table, new, new.select(*KEYS), T1, at(24))
    twice = overwrite.replace_actuals(once, new, new.select(*KEYS), T1, at(24))
    want = [(T1, 10, 2.0), (T1, 11, 1.0), (at(48), 10, 9.0)]
    assert rows_of(once, "ds", "sales_type_id", "y") == want
    assert rows_of(twice, "ds", "sales_type_id", "y") == want


def shifts(spark, hours=0):
    return spark.createDataFrame([(1,)], "location_id long").withColumn(
        "start_time_interval", F.expr(f"INTERVAL '{hours}' HOUR")
    )


def test_saving_one_department_keeps_its_siblings(spark):
    stored = spark.createDataFrame(
        [(T1, 1, 10, 5, 1.0), (T1, 1, 10, 6, 1.0)], schemas.FORECAST
    )
    made = spark.createDataFrame([(T1, 1, 10, 5, 3.0), (at(1), 1, 10, 5, 0.0)], schemas.FORECAST)
    got = overwrite.replace_forecasts(stored, made, shifts(spark), D1, D1)
    assert rows_of(got, "department_id", "yhat") == [(5, 3.0), (6, 1.0)]


def test_forecasts_are_stored_in_clock_time(spark):
    stored = spark.createDataFrame([], schemas.FORECAST)
    made = spark.createDataFrame([(T1, 1, 10, 5, 3.0)], schemas.FORECAST)
    got = overwrite.replace_forecasts(stored, made, shifts(spark, 4), D1, D1)
    assert rows_of(got, "ds") == [(at(4),)]


def test_partition_overwrite_keeps_other_days(spark, sales, tmp_path):
    path = str(tmp_path / "actual")
    writers.write_day_partitions(sales([(T1, 1, 10, 5, 1.0), (at(24), 1, 10, 5, 2.0)]), path)
    writers.write_day_partitions(sales([(T1, 1, 10, 5, 7.0)]), path)
    got = spark.read.schema(schemas.SALES).parquet(path)
    assert rows_of(got, "ds", "y") == [(T1, 7.0), (at(24), 2.0)]


def test_stored_actuals_keep_siblings_and_clear_emptied_days(spark, sales, tmp_path):
    path = str(tmp_path / "actual")
    old = [(T1, 1, 10, None, 1.0), (T1, 1, 11, 5, 1.0), (at(24), 1, 10, None, 2.0), (at(72), 1, 10, None, 4.0)]
    writers.write_day_partitions(sales(old), path)
    new = sales([(T1, 1, 10, None, 9.0), (at(100), 1, 10, None, 8.0)])
    for _ in range(2):
        overwrite.store_actuals(path, new, new.select(*KEYS), T1, at(47))
        got = spark.read.schema(schemas.SALES).parquet(path)
        want = [(T1, 10, 9.0), (T1, 11, 1.0), (at(72), 10, 4.0)]
        assert rows_of(got, "ds", "sales_type_id", "y") == want


def test_stored_forecasts_stay_within_their_days(spark, tmp_path):
    path = str(tmp_path / "forecast")
    rows = [(T1, 1, 10, 5, 1.0), (at(24), 1, 10, 5, 1.0), (T1, 1, 10, 6, 1.0)]
    writers.write_day_partitions(spark.createDataFrame(rows, schemas.FORECAST), path)
    made = spark.createDataFrame(
        [(at(24 * i), 1, 10, 5, 3.0 + i) for i in range(3)], schemas.FORECAST
    )
    for _ in range(2):
        overwrite.store_forecasts(path, made, shifts(spark, 4), D1, D1)
        got = spark.read.schema(schemas.FORECAST).parquet(path)
        want = [(T1, 5, 1.0), (T1, 6, 1.0), (at(4), 5, 3.0)]
        assert rows_of(got, "ds", "department_id", "yhat") == want


# Reading


def test_csv_forms(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(
        "ds,location_id,sales_type_id,department_id,y\n"
        "2024-01-01 00:15,1,10,102.0,1\n2024-01-01T00:30:00,1,10,,2.5\n"
        "2024-01-01 00:45:00.250000,1,10.0,5,\n"
    )
    got = [tuple(r) for r in readers.read_sales(spark, str(path)).collect()]
    day = dt.datetime(2024, 1, 1)
    assert sorted(got, key=lambda r: r[0]) == [
        (day.replace(minute=15), 1, 10, 102, 1.0),
        (day.replace(minute=30), 1, 10, None, 2.5),
        (day.replace(minute=45, microsecond=250000), 1, 10, 5, None),
    ]
    holiday = tmp_path / "holidays.csv"
    names = [f.name for f in schemas.HOLIDAY]
    values = {"corporation_id": "1.0", "holiday": "x", "lower_window": "0.0", "upper_window": "1.0"}
    row = ",".join(values.get(n, "2024-01-01") for n in names)
    holiday.write_text(",".join(names) + "\n" + row + "\n")
    read = readers.read_holidays(spark, str(holiday)).first()
    assert (read.corporation_id, read.lower_window, read.upper_window) == (1, 0, 1)


@pytest.mark.parametrize("row", ["x,1,10,5,1", "2024-01-01 00:00,1.5,10,5,1", "2024-01-01,1,1,1,a"])
def test_a_bad_field_fails_the_read(spark, tmp_path, row):
    path = tmp_path / "sales.csv"
    path.write_text("ds,location_id,sales_type_id,department_id,y\n" + row + "\n")
    with pytest.raises(Exception, match="can't be read"):
        readers.read_sales(spark, str(path)).collect()


# Publishing


def test_payload_days_start_at_business_start(spark):
    forecast = spark.createDataFrame(
        [(at(4), 1, 10, None, 1.234), (at(27.75), 1, 10, None, 2.0), (at(3), 1, 11, 6, 9.0)],
        schemas.FORECAST,
    )
    got = publish.day_payload(forecast, shifts(spark, 4), D1, D1).collect()
    by_type = {r.sales_type_id: r for r in got}
    first = by_type[10]
    assert first.belongs_to == "2024-01-01" and first.department_id is None
    assert len(first.forecasts) == 96
    assert first.forecasts[0] == "1.23" and first.forecasts[95] == "2.0"
    assert set(first.forecasts[1:95]) == {""}
    # 03:00 belongs to the day before, so this series has an all-zero day.
    assert set(by_type[11].forecasts) == {""} and by_type[11].department_id == 6


# Blending


def test_blend_thresholds(spark):
    df = spark.createDataFrame(
        [(0.9, 0.9), (1.9, 0.0), (2.0, 0.0), (5.0, 3.0)], "yhat double, yhat_b double"
    )
    got = [round(r.yhat_final, 6) for r in blend.evaluation_blend(df).collect()]
    assert got == [0.0, 0.0, 0.3, 3.3]
    got = [round(r.yhat_final, 6) for r in blend.production_blend(df).collect()]
    assert got == [0.0, 0.38, 0.4, 3.4]


@pytest.mark.parametrize(
    "rate, opened, quiet, value, want",
    [
        (0.5, 1, 0.0, 0.49, 0.0), (0.5, 1, 0.0, 0.5, 0.5), (0.5, 1, 0.0, -1.0, 0.0),
        (0.8, 0, 0.0, 5.0, 0.0), (0.9, 1, 0.0, 5.0, 5.0), (0.91, 1, 0.0, 5.0, 0.0),
        (0.5, 1, 0.71, 0.99, 0.0), (0.5, 1, 0.71, 1.0, 1.0), (0.5, 1, 0.7, 0.99, 0.99),
        (None, 1, 0.0, 5.0, 5.0),
    ],
)
def test_post_processing(spark, rate, opened, quiet, value, want):
    df = spark.createDataFrame(
        [(rate, opened, quiet, value)],
        "interval_zero_rate double, typical_open int, zero_rate double, yhat_b double",
    )
    assert blend.post_process(df, "yhat_b", zero_rate="zero_rate").first().yhat_b == want


def test_weight_tie_and_default(spark):
    tie = spark.createDataFrame([(0.2, 1.0), (0.1, 1.0), (0.3, 2.0)], "weight double, mae double")
    assert blend.best_weight(tie).first().weight == 0.1
    none = spark.createDataFrame([(0.1, None), (0.2, float("nan"))], "weight double, mae double")
    assert blend.best_weight(none).first().weight == 0.3


def test_short_series_keep_the_baseline(spark):
    base = spark.createDataFrame([(T1, 1, 10, 0, 0.4), (T1, 1, 11, 0, 0.4)], schemas.FORECAST)
    model = spark.createDataFrame([(T1, 1, 10, 0, 0.4)], schemas.FORECAST)
    model = model.withColumnRenamed("yhat", "yhat_b")
    got = blend.blend_or_baseline(base, model, "yhat_b")
    assert rows_of(got, "sales_type_id", "yhat_final") == [(10, 0.0), (11, 0.4)]


# Scores


def test_scores_match_pandas(spark):
    rng = np.random.default_rng(1)
    rows = [
        (T1 + dt.timedelta(minutes=15 * int(i)), s, 10, 0, float(y), float(p))
        for s in range(3)
        for i, y, p in zip(range(300), rng.gamma(2, 5, 300), rng.gamma(2, 5, 300))
    ]
    df = spark.createDataFrame(
        rows, "ds timestamp_ntz, location_id long, sales_type_id long, department_id long, "
        "y double, yhat double"
    )
    frame = df.toPandas()
    want = {"15min": (frame.y - frame.yhat).abs().groupby(frame.location_id).mean().median()}
    for grain, bucket in [("hourly", frame.ds.dt.floor("h")), ("daily", frame.ds.dt.date)]:
        sums = frame.groupby(["location_id", bucket])[["y", "yhat"]].sum()
        errors = (sums.y - sums.yhat).abs().groupby("location_id").mean()
        want[grain] = errors.median()
    want["combined"] = sum(want.values()) / 3
    got = {r.grain: r.mae for r in evaluate.evaluate(df).collect()}
    assert got == pytest.approx(want)


def test_zero_denominators(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "y double, yhat double")
    row = evaluate.zero_metrics(df, ["yhat"]).first()
    assert (row.precision, row.recall) == (0.0, 0.0)
    base = spark.createDataFrame([("daily", 0.0)], "grain string, mae double")
    report = evaluate.comparison_report(base, base).first()
    assert report.improvement_pct is None and report.target_met == 0
    same = spark.createDataFrame([(1, 10, 0, 1.0, 1.0)], ", ".join(f"{k} long" for k in KEYS)
                                 + ", y double, yhat double")
    assert evaluate.location_improvement(same, "yhat", "yhat").first().improvement_pct == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1001, 5000])
def test_median_of_far_clusters_and_ties(spark, n):
    rng = np.random.default_rng(n)
    heavy = np.exp(rng.normal(0, 8, n))
    # Two far clusters: with an even count the middle values lie in different ones.
    far = np.where(np.arange(n) < n // 2, rng.random(n), 1e9 + rng.random(n))
    ties = rng.integers(0, 3, n).astype(float)
    rows = [
        (float(a), float(b), float(c) if i % 7 else None)
        for i, (a, b, c) in enumerate(zip(heavy, far, ties))
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r.column: r.median for r in medians_by_column(df, ["a", "b", "c"], 7).collect()}
    known = [c for _, _, c in rows if c is not None]
    assert got["a"] == pytest.approx(np.median(heavy))
    assert got["b"] == pytest.approx(np.median(far))
    assert got.get("c") == (pytest.approx(np.median(known)) if known else None)


@pytest.mark.parametrize("cells", [2, 5, 256])
def test_medians_are_exact(spark, cells):
    nan, inf = float("nan"), float("inf")
    columns = {
        "a": [float(i) for i in range(1001)],
        "b": [float(i * i) for i in range(1000)] + [None],
        "c": [1.0, nan, inf, -inf, 2.0] * 200 + [nan],
        "d": [nan] * 700 + [0.0] * 301,
        "e": [None] * 1001,
        "f": [7.0] * 1000 + [8.0],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    got = {r["column"]: r["median"] for r in medians_by_column(df, list(columns), cells).collect()}
    want = df.selectExpr(*[f"median({c}) AS {c}" for c in columns]).first().asDict()
    assert {c: repr(got.get(c)) for c in columns} == {c: repr(v) for c, v in want.items()}
    nothing = column_medians(df, ["e"]).collect()
    assert [tuple(r) for r in nothing] == [(None,)]


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.37, 1.0])
def test_sample_of_an_exact_number_of_series(spark, fraction):
    """Whole series, null departments included, and the same ones for the same seed."""
    rows = [(i % 120, 7, None if i % 3 else i % 2, float(i)) for i in range(1200)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} long" for k in KEYS) + ", y double")
    size = df.select(*KEYS).distinct().count()
    taken = clean.series_sample(df, fraction, seed=3)
    series = {(r.location_id, r.department_id) for r in taken.collect()}
    assert len(series) == int(size * fraction)
    whole = [r for r in rows if (r[0], r[2]) in series]
    assert taken.count() == len(whole)
    again = clean.series_sample(df.repartition(5), fraction, seed=3)
    assert {(r.location_id, r.department_id) for r in again.collect()} == series
    assert clean.series_sample(df.limit(0), fraction, seed=3).collect() == []


# Hierarchy, sources and storage


def test_forecast_grid(spark):
    location = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], schemas.LOCATION_CSV)
    types = spark.createDataFrame(
        [(10, 1, "L", True), (11, 1, "D", True), (12, 1, "D", False), (20, 2, "D", True)],
        "id long, corporation_id long, level string, forecast_enabled boolean",
    )
    department = spark.createDataFrame([(5, 1), (6, 1)], "id long, corporation_id long")
    grid = hierarchy.forecast_grid(location, types, department).collect()
    got = {(r.location_id, r.sales_type_id, r.department_id) for r in grid}
    assert got == {(1, 10, None), (1, 11, 5), (1, 11, 6)}


def test_csv_keeps_leading_zeros_and_fractions(spark, tmp_path):
    moment = dt.datetime(2024, 1, 1, 0, 0, 0, 250000)
    df = spark.createDataFrame([("007", moment, 1.5, None, 0.0, 0.1)], schemas.WEATHER)
    writers.write_csv(df, str(tmp_path / "w"))
    assert readers.read_weather(spark, str(tmp_path / "w")).collect() == df.collect()


def test_csv_folder_loads_and_filters(spark, tmp_path):
    moments = [(at(i), 1 + i % 2, 10, None if i % 2 else 5, 1.0) for i in range(6)]
    files = {
        "sales": spark.createDataFrame(moments, schemas.SALES),
        "weather": spark.createDataFrame([("007", T1, 1.0, 0.0, 0.0, 0.0)], schemas.WEATHER),
        "holiday": holidays(spark),
        "locations": locations(spark),
    }
    for name, rows in files.items():
        writers.write_csv(rows, str(tmp_path / f"{name}.csv"))
    tables = load_csv_tables(spark, str(tmp_path), location_id=2)
    assert rows_of(tables.sales.distinct(), "location_id", "department_id")[0] == (2, 0)
    assert tables.sales.count() == 3 and tables.location.count() == 1
    assert tables.holiday.filter("lower_window > 0").isEmpty()


def test_rows_that_do_not_parse_are_set_aside(spark, tmp_path):
    folder = tmp_path / "sales"
    folder.mkdir()
    head = "ds,location_id,sales_type_id,department_id,y\n"
    (folder / "a.csv").write_text(head + "2024-01-01 00:00,1,10,,1.5\n,2.0, ,3,x\nno,2.5,1,1,2\n")
    (folder / "b.csv").write_text(head + "2024-01-01T00:15:00,1,10\n2024-01-01 00:30,1,10,5,2,9\n")
    (folder / "c.csv").write_text(head + '2024-01-01 00:45,3,30,7,"4"\n')
    load = readers.load_csv(spark, str(folder), schemas.SALES, most_rejected=0.7)
    assert (load.n_rows, load.n_rejected) == (6, 4)
    assert rows_of(load.rows, "location_id", "department_id", "y") == [(1, None, 1.5), (3, 7, 4.0)]
    bad = {(r.file.rsplit("/", 1)[1], r.column, r.text) for r in load.rejects.collect()}
    assert bad == {
        ("a.csv", "y", "x"),
        ("a.csv", "ds", "no"),
        ("a.csv", "location_id", "2.5"),
        ("b.csv", None, "2024-01-01T00:15:00,1,10"),
        ("b.csv", None, "2024-01-01 00:30,1,10,5,2,9"),
    }
    with pytest.raises(readers.TooManyRejects, match="4 of 6 rows") as found:
        readers.load_csv(spark, str(folder), schemas.SALES, most_rejected=0.5)
    assert spark.read.parquet(str(found.value).rsplit(" ", 1)[1]).count() == 5
    empty = tmp_path / "empty.csv"
    empty.write_text(head)
    load = readers.load_csv(spark, str(empty), schemas.SALES)
    assert (load.n_rows, load.n_rejected, load.rows.count()) == (0, 0, 0)


def test_jdbc_options_are_parallel():
    options = readers.jdbc_options("jdbc:x", "actual", "ds", "2024-01-01", "2024-02-01", 16)
    assert options["numPartitions"] == "16" and options["partitionColumn"] == "ds"


def test_scan_pushes_down(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    df = readers.scan(orders, ["o_orderkey"], F.col("o_custkey") == 7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "o_totalprice" not in plan


def test_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(ValueError):
        storage.shared_folder(Session())


def test_materialize_keeps_rows_and_cuts_the_plan(spark):
    df = spark.range(10).withColumn("b", F.col("id") * 2)
    kept = storage.materialize(df, "t")
    assert rows_of(kept, "*") == rows_of(df, "*")
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()

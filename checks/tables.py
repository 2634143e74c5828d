"""Sources, sinks, projections, filters and joins."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.data import FIRST_DAY, LAST_DAY, Data, r, rounded
from checks.registry import check
from checks.sql import K, on
from checks.sql import r as sql_r
from slotcast import schemas
from slotcast.functions import scalars as fn
from slotcast.functions.calendar import moment, to_business_time, to_clock_time, with_calendar
from slotcast.operators import clean, evaluate, gapfill, hierarchy, overwrite, publish
from slotcast.operators import holidays as hol
from slotcast.operators import profile as prof
from slotcast.operators import weather as wx
from slotcast.operators.audit import key_membership
from slotcast.operators.baseline import baseline_forecast
from slotcast.operators.blend import evaluation_blend, pair_predictions
from slotcast.operators.features import fill_with_medians
from slotcast.operators.windows import with_history
from slotcast.plans.production import HORIZON_DAYS, Store, reingest_actuals
from slotcast.schemas import KEYS
from slotcast.sources import readers, snapshots, writers
from slotcast.sources.storage import new_path

LIMITS = {"min_rows": 20, "min_train": 10, "min_test": 4}
D10, D12 = dt.date(2024, 1, 10), dt.date(2024, 1, 12)
T10, T12 = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)
WEATHER_SQL = ", ".join(
    f"{sql_r(c)} AS {c}" for c in ["real_feel", "precipitation", "snow", "coverage"]
)


def baseline(d: Data):
    return baseline_forecast(d.panel, d.labels, **LIMITS)


def csv_round_trip(d: Data, rows, reader, compression: str = "none"):
    path = new_path(d.spark, "csv")
    writers.write_csv(rows, path, compression)
    return reader(d.spark, path)


# Sources


@check("s1_read_sales_csv", f"SELECT ds, {K}, y FROM salesd")
def _(d):
    rows = d.sales_by_department.select(*schemas.SALES.fieldNames())
    return csv_round_trip(d, rows, readers.read_sales)


# Every seventh event in a thousand has a time, every eleventh a key, every thirteenth a value
# that isn't one; every seventeenth lacks a field.
_SOILED = """(SELECT event_id,
    CASE WHEN event_id % 1000 = 7 THEN 'noon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ds,
    CASE WHEN event_id % 1000 IN (7, 11) THEN 'x' || user_id ELSE user_id::VARCHAR END AS location_id,
    CASE WHEN event_id % 1000 = 13 THEN '1,5' ELSE event_id::VARCHAR END AS y,
    event_id % 1000 = 17 AS is_short FROM events)"""


def _soiled(d):
    """Sales as CSV text with planted faults, several files."""
    event = F.col("event_id")
    part = event % 1000
    ds = F.when(part == 7, F.lit("noon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    user = F.col("user_id").cast("string")
    location = F.when(part.isin(7, 11), F.concat(F.lit("x"), user)).otherwise(user)
    y = F.when(part == 13, F.lit('"1,5"')).otherwise(event.cast("string"))
    full = F.concat_ws(",", ds, location, F.lit("1"), F.lit(""), y)
    line = F.when(part == 17, F.concat_ws(",", ds, location)).otherwise(full)
    path = new_path(d.spark, "soiled")
    # One file for each part, which begins with its header.
    rows = d.table("events").select((event % 4).alias("part"), F.lit(1).alias("rank"), line.alias("value"))
    head = F.lit(",".join(schemas.SALES.fieldNames()))
    heads = d.spark.range(4).select(F.col("id").alias("part"), F.lit(0).alias("rank"), head.alias("value"))
    dealt = rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "rank")
    dealt.select("part", "value").write.partitionBy("part").text(path)
    return path


@check(
    "s1_csv_rows_kept",
    f"""SELECT strptime(ds, '%Y-%m-%d %H:%M:%S') AS ds, location_id::BIGINT AS location_id,
    1::BIGINT AS sales_type_id, NULL::BIGINT AS department_id, y::DOUBLE AS y FROM {_SOILED}
    WHERE event_id % 1000 NOT IN (7, 11, 13, 17)""",
)
def _(d):
    return readers.load_csv(d.spark, _soiled(d), schemas.SALES, most_rejected=0.01).rows


@check(
    "s1_csv_rejects",
    f"""SELECT "column", text, count(*) AS n FROM (
    SELECT 'ds' AS "column", ds AS text FROM {_SOILED} WHERE event_id % 1000 = 7
    UNION ALL SELECT 'location_id', location_id FROM {_SOILED} WHERE event_id % 1000 IN (7, 11)
    UNION ALL SELECT 'y', y FROM {_SOILED} WHERE event_id % 1000 = 13
    UNION ALL SELECT NULL, ds || ',' || location_id FROM {_SOILED} WHERE is_short) GROUP BY ALL""",
)
def _(d):
    load = readers.load_csv(d.spark, _soiled(d), schemas.SALES, most_rejected=0.01)
    return load.rejects.groupBy("column", "text").agg(F.count("*").alias("n"))


@check("s2_read_weather_csv", f"SELECT postal_code, ds, {WEATHER_SQL} FROM weather")
def _(d):
    rows = d.weather.select(*schemas.WEATHER.fieldNames())
    read = csv_round_trip(d, rows, readers.read_weather)
    return rounded(read, *schemas.WEATHER_VALUES)


@check(
    "s3_read_holiday_csv",
    "SELECT corporation_id, ds, holiday, lower_window, upper_window FROM holiday",
)
def _(d):
    return csv_round_trip(d, d.holiday, readers.read_holidays)


@check("s4_read_locations_csv", "SELECT id, corporation_id, postal_code FROM location")
def _(d):
    rows = d.location.select(*schemas.LOCATION_CSV.fieldNames())
    return csv_round_trip(d, rows, readers.read_locations)


@check("s5_read_department_csv", "SELECT id, corporation_id, name FROM department")
def _(d):
    rows = d.department.select(*schemas.DEPARTMENT.fieldNames())
    return csv_round_trip(d, rows, readers.read_departments)


@check("s6_read_sales_type_csv", "SELECT id, corporation_id, name, level FROM sales_type")
def _(d):
    rows = d.sales_type.select(*schemas.SALES_TYPE.fieldNames())
    return csv_round_trip(d, rows, readers.read_sales_types)


@check("s7_gzip_csv_to_parquet", f"SELECT ds, {K}, y FROM salesd")
def _(d):
    rows = d.sales_by_department.select(*schemas.SALES.fieldNames())
    path, target = new_path(d.spark, "gz"), new_path(d.spark, "parquet")
    writers.write_csv(rows, path, "gzip")
    return readers.gzip_csv_to_parquet(d.spark, path, schemas.SALES, target)


@check(
    "s8_table_scan",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'""",
)
def _(d):
    first, last = dt.datetime(1996, 1, 1), dt.datetime(1997, 12, 31)
    dates = F.col("o_orderdate").between(moment(first), moment(last))
    return readers.scan(d.table("orders"), ["o_orderkey", "o_custkey", "o_totalprice"], dates)


@check(
    "s9_reread_predictions",
    f"SELECT ds, {K}, {sql_r('y')} AS y, {sql_r('yhat')} AS yhat FROM e_pred",
)
def _(d):
    rows = baseline(d).select(*schemas.PREDICTION.fieldNames())
    return rounded(csv_round_trip(d, rows, readers.read_predictions), "y", "yhat")


@check("s10_read_metrics_json", f"SELECT grain, {sql_r('mae')} AS mae FROM esc_mae")
def _(d):
    path = new_path(d.spark, "metrics")
    writers.write_metrics(evaluate.evaluate(baseline(d)), path)
    return rounded(readers.read_metrics(d.spark, path), "mae")


@check(
    "s11_location_holidays",
    """SELECT l.id AS location_id, corporation_id, h.ds, h.holiday, lower_window, upper_window
    FROM location l JOIN holiday h USING (corporation_id)""",
)
def _(d):
    return hol.location_holidays(d.location, d.holiday)


@check(
    "s12_forecasts_between",
    f"""SELECT ds, {K}, yhat FROM forecast
    WHERE ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'""",
)
def _(d):
    return readers.forecasts_between(d.forecast, T10, T12)


# Sinks


@check(
    "k1_write_predictions",
    f"SELECT ds, {K}, {sql_r('y')} AS y, {sql_r('yhat')} AS yhat FROM e_pred",
)
def _(d):
    path = new_path(d.spark, "predictions")
    writers.write_predictions(baseline(d), path)
    read = d.spark.read.schema(schemas.PREDICTION).parquet(path)
    return rounded(read, "y", "yhat")


@check(
    "k2_write_metrics",
    f"""SELECT {sql_r('a')} AS mae_15min, {sql_r('b')} AS mae_hourly, {sql_r('c')} AS mae_daily,
    {sql_r('(a + b + c) / 3')} AS mae_combined FROM base_med""",
)
def _(d):
    path = new_path(d.spark, "metrics")
    writers.write_metrics(evaluate.evaluate(d.pairs), path)
    document = d.spark.read.schema(schemas.METRICS).json(path)
    return document.select(*[r(f"{g}").alias(f"mae_{g}") for g in schemas.METRICS.fieldNames()])


def _zero_rate_sql(column: str, of: str) -> str:
    return f"""(SELECT coalesce(count(*) FILTER (y = 0 AND {column} = 0)
        / nullif(count(*) FILTER ({of} = 0), 0), 0) FROM blended)"""


@check(
    "k2_write_comparison",
    f"""SELECT grain, {sql_r("b.mae")} AS baseline_mae, {sql_r("f.mae")} AS model_mae,
    {sql_r("(b.mae - f.mae) / b.mae * 100")} AS improvement_pct,
    {sql_r(_zero_rate_sql("yhat_final", "yhat_final"))} AS zero_precision,
    {sql_r(_zero_rate_sql("yhat_final", "y"))} AS zero_recall
    FROM base_mae b JOIN final_mae f USING (grain)""",
)
def _(d):
    pairs = d.pairs
    final = evaluation_blend(pairs)
    report = evaluate.comparison_report(
        evaluate.evaluate(pairs), evaluate.evaluate(final, "yhat_final")
    )
    path = new_path(d.spark, "comparison")
    writers.write_comparison(report, evaluate.zero_metrics(final, ["yhat", "yhat_final"]), path)
    document = d.spark.read.schema(schemas.COMPARISON).json(path)
    rates = F.col("zero_metrics")["yhat_final"]
    grains = F.explode(F.map_keys("baseline_mae")).alias("grain")
    rows = document.select("*", grains)
    return rows.select(
        "grain",
        *[r(F.col(c)[F.col("grain")]).alias(c) for c in schemas.COMPARISON.fieldNames()[:3]],
        r(rates["precision"]).alias("zero_precision"),
        r(rates["recall"]).alias("zero_recall"),
    )


_REPLACED_ACTUALS = f"""SELECT s.ds, {K}, y FROM salesd s
    WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE
        b.location_id = s.location_id AND b.sales_type_id = s.sales_type_id
        AND b.department_id IS NOT DISTINCT FROM s.department_id
        AND s.ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12')
    UNION ALL SELECT ds, {K}, y FROM batch"""


@check("k3_replace_actuals", _REPLACED_ACTUALS)
def _(d):
    series = d.batch.select(*KEYS).distinct()
    return overwrite.replace_actuals(d.sales_by_department, d.batch, series, T10, T12)


@check("k3_overwrite_day_partitions", _REPLACED_ACTUALS)
def _(d):
    path = new_path(d.spark, "actual")
    writers.write_day_partitions(d.sales_by_department, path)
    series = d.batch.select(*KEYS).distinct()
    overwrite.store_actuals(path, d.batch, series, T10, T12)
    return d.spark.read.schema(schemas.SALES).parquet(path).drop("date")


_REPLACED_FORECASTS = f"""SELECT f.ds, {K}, yhat FROM forecast f WHERE NOT EXISTS (
        SELECT 1 FROM panel p JOIN shifts s USING (location_id)
        WHERE {on("p", "f", "location_id, sales_type_id")}
        AND p.department_id IS NOT DISTINCT FROM f.department_id
        AND f.ds BETWEEN TIMESTAMP '2024-01-10' + s.start_time_interval
            AND TIMESTAMP '2024-01-12 23:45' + s.start_time_interval)
    UNION ALL SELECT p.ds + s.start_time_interval, {K}, round(y - 20, 2)
    FROM panel p JOIN shifts s USING (location_id)
    WHERE p.ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:45'
    AND round(y - 20, 2) > 0"""


def _made(d, last):
    return clean.business_days(d.panel, D10, last).select(
        "ds", *KEYS, F.round(F.col("y") - 20, 2).alias("yhat")
    )


@check("k4_replace_forecasts", _REPLACED_FORECASTS)
def _(d):
    return overwrite.replace_forecasts(d.forecast, _made(d, D12), d.shifts, D10, D12)


@check("k4_stored_twice", _REPLACED_FORECASTS)
def _(d):
    """Rows made beyond the last day aren't stored, and a second run changes nothing."""
    path = new_path(d.spark, "forecast")
    writers.write_day_partitions(d.forecast, path)
    made = _made(d, D12 + dt.timedelta(days=2))
    for _ in range(2):
        overwrite.store_forecasts(path, made, d.shifts, D10, D12)
    return d.spark.read.schema(schemas.FORECAST).parquet(path).drop("date")


@check(
    "k4_store_first_time",
    f"""SELECT p.ds + s.start_time_interval AS ds, {K}, round(y - 20, 2) AS yhat
    FROM panel p JOIN shifts s USING (location_id)
    WHERE p.ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:45'
    AND round(y - 20, 2) > 0""",
)
def _(d):
    """A first store into an absent table, whose rows a later commit of the same run keeps."""
    path = new_path(d.spark, "forecast")
    for _ in range(2):
        overwrite.commit_forecasts(path, _made(d, D12), d.shifts, D10, D12)
    return snapshots.read_days(d.spark, path, schemas.FORECAST)


@check("k4_commit_forecasts", _REPLACED_FORECASTS)
def _(d):
    """A range of a table of snapshots, replaced by one commit."""
    path = new_path(d.spark, "forecast")
    snapshots.commit_days(path, d.forecast)
    made = _made(d, D12 + dt.timedelta(days=2))
    overwrite.commit_forecasts(path, made, d.shifts, D10, D12)
    return snapshots.read_days(d.spark, path, schemas.FORECAST)


@check("k3_commit_actuals", _REPLACED_ACTUALS)
def _(d):
    path = new_path(d.spark, "actual")
    snapshots.commit_days(path, d.sales_by_department)
    overwrite.commit_actuals(path, d.batch, d.batch.select(*KEYS).distinct(), T10, T12)
    return snapshots.read_days(d.spark, path, schemas.SALES)


@check(
    "s9_read_snapshot_days",
    f"""SELECT ds, {K}, yhat FROM forecast
    WHERE ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:59:59'""",
)
def _(d):
    """An older snapshot stays as it was, and only its dates asked for are read."""
    path = new_path(d.spark, "forecast")
    first = snapshots.commit_days(path, d.forecast)
    snapshots.commit_days(path, d.forecast.limit(0), D10, D12)
    return snapshots.read_days(d.spark, path, schemas.FORECAST, D10, D12, version=first)


@check(
    "k4_replace_forecasts_next_day_scope",
    f"""SELECT f.ds, {K}, yhat FROM forecast f WHERE NOT EXISTS (
        SELECT 1 FROM salesd p JOIN shifts s USING (location_id)
        WHERE p.ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:45'
        AND {on("p", "f", "location_id, sales_type_id")}
        AND f.ds BETWEEN TIMESTAMP '2024-01-11' + s.start_time_interval
            AND TIMESTAMP '2024-01-12 23:45' + s.start_time_interval)
    UNION ALL SELECT p.ds + s.start_time_interval, {K}, y
    FROM salesd p JOIN shifts s USING (location_id)
    WHERE p.ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:45' AND y > 0""",
)
def _(d):
    made = clean.business_days(d.forecast, D10, D12)
    two_keys = ["location_id", "sales_type_id"]
    return overwrite.replace_forecasts(
        d.forecast, made, d.shifts, D10, D12, keep_first_day=True, keys=two_keys
    )


def payload_sql(columns: str) -> str:
    return f"""SELECT {columns} FROM (
        SELECT k.location_id, k.sales_type_id, k.department_id, day::DATE AS date,
            list(coalesce(f.v, 0) ORDER BY slot) AS vals
        FROM (SELECT DISTINCT {K}, start_time_interval FROM forecast
              JOIN shifts USING (location_id)
              WHERE ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-14') k
        CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-10',
            TIMESTAMP '2024-01-12', INTERVAL 1 DAY)) AS day)
        CROSS JOIN (SELECT unnest(generate_series(0, 95)) AS slot)
        LEFT JOIN (SELECT ds, {K}, round(yhat, 2) AS v FROM forecast) f
            ON f.location_id = k.location_id AND f.sales_type_id = k.sales_type_id
            AND f.department_id IS NOT DISTINCT FROM k.department_id
            AND f.ds = day + k.start_time_interval + slot::INT * INTERVAL 15 MINUTE
        GROUP BY ALL)"""


_JOINED = """array_to_string(list_transform(vals,
    lambda x: CASE WHEN x = 0 THEN '' ELSE x::VARCHAR END), '|')"""


@check(
    "k5_day_payload_json",
    payload_sql(
        f"date::VARCHAR AS belongs_to, len(vals) AS n_values, {_JOINED} AS forecasts, {K}"
    ),
)
def _(d):
    path = new_path(d.spark, "payload")
    writers.write_payload(publish.day_payload(d.forecast, d.shifts, D10, D12), path)
    schema = T.StructType(
        [
            T.StructField("belongs_to", T.StringType()),
            T.StructField("forecasts", T.ArrayType(T.StringType())),
            *[T.StructField(k, T.LongType()) for k in KEYS],
        ]
    )
    read = d.spark.read.schema(schema).json(path)
    return read.select(
        "belongs_to",
        F.size("forecasts").cast("long").alias("n_values"),
        F.array_join("forecasts", "|").alias("forecasts"),
        *KEYS,
    )


@check(
    "k6_comparison_report",
    f"""SELECT grain, {sql_r("b.mae")} AS baseline_mae, {sql_r("f.mae")} AS model_mae,
    {sql_r("(b.mae - f.mae) / b.mae * 100")} AS improvement_pct,
    CASE WHEN (b.mae - f.mae) / b.mae * 100 >= 20 THEN 1 ELSE 0 END AS target_met
    FROM base_mae b JOIN final_mae f USING (grain)""",
)
def _(d):
    pairs = d.pairs
    final = evaluate.evaluate(evaluation_blend(pairs), "yhat_final")
    report = evaluate.comparison_report(evaluate.evaluate(pairs), final)
    return rounded(report, "baseline_mae", "model_mae", "improvement_pct")


# Projections and filters


@check("p1_parse_ds", "SELECT event_id, time_bucket(INTERVAL 1 SECOND, ts) AS ds FROM events")
def _(d):
    text = d.table("events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ds")
    )
    return clean.parse_ds(text)


@check(
    "p2_fill_department",
    """SELECT ds, location_id, sales_type_id, coalesce(department_id, 0) AS department_id, y
    FROM salesd""",
)
def _(d):
    return clean.fill_department(d.sales_by_department)


@check(
    "p3_fix_lower_window",
    """SELECT corporation_id, ds, holiday, -abs(lower_window) AS lower_window, upper_window
    FROM holiday""",
)
def _(d):
    return clean.fix_holiday_windows(d.holiday)


@check("p4_at_location", f"SELECT ds, {K}, y FROM panel WHERE location_id = 3")
def _(d):
    return clean.at_location(d.panel, 3)


@check(
    "p5_forecast_enabled",
    """SELECT s.id AS sales_type_id, count(*) AS n_rows FROM salesd f
    JOIN sales_type s ON s.id = f.sales_type_id WHERE s.forecast_enabled GROUP BY ALL""",
)
def _(d):
    enabled = clean.forecast_enabled(d.sales_type).select(F.col("id").alias("sales_type_id"))
    sold = d.sales_by_department.join(enabled, "sales_type_id")
    return sold.groupBy("sales_type_id").agg(F.count(F.lit(1)).alias("n_rows"))


_SHIFTED = "panel p JOIN shifts s USING (location_id)"


@check(
    "p6_business_date_range",
    f"""SELECT ds, {K}, y FROM {_SHIFTED}
    WHERE ds BETWEEN TIMESTAMP '2024-01-10' + start_time_interval
    AND TIMESTAMP '2024-01-12 23:45' + start_time_interval""",
)
def _(d):
    rows = d.panel.join(d.shifts, "location_id")
    return clean.business_days(rows, D10, D12, "start_time_interval").select("ds", *KEYS, "y")


@check(
    "p7_task_filter",
    f"SELECT ds, {K}, y FROM salesd WHERE sales_type_id = 13 AND department_id = 102",
)
def _(d):
    return clean.of_task(d.sales_by_department, 13, 102)


@check(
    "p7_task_series",
    f"""SELECT ds, location_id, sales_type_id,
    CASE WHEN level = 'L' THEN 0 ELSE department_id END AS department_id, {sql_r("sum(y)")} AS y
    FROM salesd f JOIN sales_type t ON t.id = f.sales_type_id
    GROUP BY 1, 2, 3, 4""",
)
def _(d):
    return rounded(clean.task_series(d.sales_by_department, d.sales_type), "y")


@check(
    "p8_sparse_forecast",
    f"SELECT ds, {K}, round(y - 20, 2) AS yhat FROM dense WHERE round(y - 20, 2) > 0",
)
def _(d):
    shifted = d.dense.select("ds", *KEYS, F.round(F.col("y") - 20, 2).alias("yhat"))
    return clean.sparse_forecast(shifted)


@check(
    "p9_time_of_day",
    f"""SELECT postal_code, ds, {sql_r('real_feel')} AS real_feel FROM weather
    WHERE ds::TIME BETWEEN TIME '06:00' AND TIME '20:00'""",
)
def _(d):
    rows = clean.time_of_day(d.weather, 6 * 60, 20 * 60)
    return rows.select("postal_code", "ds", r("real_feel").alias("real_feel"))


@check(
    "p10_business_shift",
    f"""SELECT ds, {K}, ds - start_time_interval AS business_ds,
    ds + start_time_interval AS clock_ds FROM {_SHIFTED}""",
)
def _(d):
    shift = F.col("start_time_interval")
    return d.panel.join(d.shifts, "location_id").select(
        "ds",
        *KEYS,
        to_business_time(F.col("ds"), shift).alias("business_ds"),
        to_clock_time(F.col("ds"), shift).alias("clock_ds"),
    )


_BELONGS = """CASE WHEN epoch(ds::TIME) < epoch(start_time_interval)
    THEN ds - INTERVAL 1 DAY ELSE ds END"""


@check("p11_belongs_to_shift", f"SELECT ds, {K}, {_BELONGS} AS belongs_to_ds FROM {_SHIFTED}")
def _(d):
    rows = publish.with_belongs_to(d.panel.join(d.shifts, "location_id"))
    return rows.select("ds", *KEYS, "belongs_to_ds")


@check(
    "p12_post_window",
    f"""SELECT * FROM (SELECT ds, {K}, {_BELONGS} AS belongs_to_ds FROM {_SHIFTED})
    WHERE belongs_to_ds >= TIMESTAMP '2024-01-10' AND belongs_to_ds < TIMESTAMP '2024-01-13'""",
)
def _(d):
    rows = publish.with_belongs_to(d.panel.join(d.shifts, "location_id"))
    inside = publish.in_post_window(rows, D10, D12, "belongs_to_ds")
    return inside.select("ds", *KEYS, "belongs_to_ds")


_WEATHERED = f"""panel p JOIN location l ON l.id = p.location_id
    LEFT JOIN hourly_weather w ON w.postal_code = l.postal_code
    AND w.hour_floor = time_bucket(INTERVAL 1 HOUR, p.ds)"""
_WX = ["real_feel", "precipitation", "snow", "coverage"]


@check(
    "p13_fill_zero",
    f"SELECT ds, {K}, " + ", ".join(f"{sql_r(f'coalesce(w.{c}, 0)')} AS {c}" for c in _WX)
    + """ FROM panel p JOIN location l ON l.id = p.location_id
    LEFT JOIN weather_daily w ON w.postal_code = l.postal_code AND w.weather_date = p.ds::DATE""",
)
def _(d):
    rows = wx.with_daily_weather(wx.with_postal_code(d.panel, d.location), d.weather_daily)
    return rounded(clean.fill_zero(rows, _WX), *_WX).select("ds", *KEYS, *_WX)


_PROFILE_NAMES = ["interval_mean", "interval_median", "interval_std", "interval_zero_rate"]


@check(
    "p14_fill_median",
    f"""SELECT ds, {K}, """
    + ", ".join(
        f"{sql_r(f'coalesce({c}, (SELECT median({c}) FROM profiled))')} AS {c}"
        for c in _PROFILE_NAMES
    )
    + " FROM profiled",
    profiled=f"SELECT * FROM calendar JOIN profile USING ({K}, interval_of_day, dayofweek)",
)
def _(d):
    rows = prof.with_profile(with_calendar(d.panel))
    filled = fill_with_medians(rows, _PROFILE_NAMES)
    return rounded(filled, *_PROFILE_NAMES).select("ds", *KEYS, *_PROFILE_NAMES)


_LAG672 = f"""SELECT ds, {K}, y, lag(y, 672) OVER (PARTITION BY {K} ORDER BY ds) AS lag_672_15min
    FROM dense"""


@check("p16_without_warmup", f"SELECT * FROM ({_LAG672}) WHERE lag_672_15min IS NOT NULL")
def _(d):
    rows = with_history(d.dense).select("ds", *KEYS, "y", "lag_672_15min")
    return clean.without_warmup(rows)


@check(
    "p17_long_enough",
    f"""SELECT ds, {K}, y FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS n FROM panel)
    WHERE n >= 370""",
)
def _(d):
    return clean.long_enough(d.panel, 370)


@check("p18_select_rename", f"SELECT ds, {K}, yhat_b AS yhat FROM pairs")
def _(d):
    return d.pairs.select("ds", *KEYS, "yhat_b").withColumnRenamed("yhat_b", "yhat")


@check(
    "p19_attach_keys",
    f"SELECT ds, {K}, y, 1 AS model FROM panel",
)
def _(d):
    return d.panel.select("ds", *KEYS, "y", F.lit(1).alias("model"))


@check(
    "p20_weather_fallback",
    f"""SELECT ds, {K}, 0.0::DOUBLE AS real_feel, 0.0::DOUBLE AS precipitation,
    0.0::DOUBLE AS snow, 0.0::DOUBLE AS coverage FROM panel""",
)
def _(d):
    return wx.with_hourly_weather(d.panel, None).select("ds", *KEYS, *_WX)


# Joins

_PROFILE_SQL = ", ".join(f"{sql_r(c)} AS {c}" for c in _PROFILE_NAMES)


@check(
    "j1_attach_profile",
    f"""SELECT ds, {K}, y, {_PROFILE_SQL} FROM calendar
    LEFT JOIN profile USING ({K}, interval_of_day, dayofweek)""",
)
def _(d):
    rows = with_calendar(d.panel)
    joined = prof.attach_profile(rows, prof.interval_profile(rows))
    return rounded(joined, *_PROFILE_NAMES).select("ds", *KEYS, "y", *_PROFILE_NAMES)


@check(
    "j2_postal_code",
    f"""SELECT ds, {K}, y, postal_code FROM panel p
    LEFT JOIN location l ON l.id = p.location_id""",
)
def _(d):
    return wx.with_postal_code(d.panel, d.location).select("ds", *KEYS, "y", "postal_code")


@check("j3_hourly_weather", f"SELECT ds, {K}, {WEATHER_SQL} FROM {_WEATHERED}")
def _(d):
    rows = wx.with_hourly_weather(wx.with_postal_code(d.panel, d.location), d.weather)
    return rounded(rows, *_WX).select("ds", *KEYS, *_WX)


@check(
    "j4_holiday_flag",
    f"""SELECT p.ds, {K}, CASE WHEN EXISTS (SELECT 1 FROM holiday h JOIN location l
        ON l.corporation_id = h.corporation_id AND l.id = p.location_id
        WHERE h.ds = p.ds::DATE) THEN 1 ELSE 0 END AS is_holiday FROM panel p""",
)
def _(d):
    dates = hol.holiday_dates(d.holiday, by_corporation=True)
    return hol.with_holiday_flag(d.panel, dates, d.location).select("ds", *KEYS, "is_holiday")


@check(
    "j4_holiday_flag_any_corporation",
    f"""SELECT p.ds, {K}, CASE WHEN p.ds::DATE IN (SELECT ds FROM holiday)
    THEN 1 ELSE 0 END AS is_holiday FROM panel p""",
)
def _(d):
    dates = hol.holiday_dates(d.holiday)
    return hol.with_holiday_flag(d.panel, dates).select("ds", *KEYS, "is_holiday")


@check(
    "j5_series_holidays",
    f"""SELECT {K}, h.ds, h.holiday FROM (SELECT DISTINCT {K} FROM panel) k
    JOIN location l ON l.id = k.location_id JOIN holiday h USING (corporation_id)""",
)
def _(d):
    holidays = hol.location_holidays(d.location, d.holiday)
    series = prof.series_keys(d.panel)
    return series.join(holidays, "location_id").select(*KEYS, "ds", "holiday")


@check(
    "j6_actuals_join_forecast",
    f"""SELECT p.ds, {K}, y, {sql_r('yhat')} AS yhat FROM panel p
    JOIN (SELECT ds, {K}, yhat FROM e_pred) USING (ds, {K})""",
)
def _(d):
    joined = d.panel.join(baseline(d).drop("y"), ["ds", *KEYS])
    return rounded(joined, "yhat")


@check("j7_prediction_pairs", f"SELECT ds, {K}, y, yhat, yhat_b FROM pairs")
def _(d):
    pairs = d.pairs
    model = pairs.select("ds", *KEYS, "yhat_b")
    return pair_predictions(pairs.drop("yhat_b"), model, "yhat_b")


@check(
    "j8_enabled_sales_types",
    f"""SELECT f.ds, {K}, y FROM salesd f JOIN sales_type t
    ON t.id = f.sales_type_id AND t.forecast_enabled""",
)
def _(d):
    enabled = clean.forecast_enabled(d.sales_type).select(F.col("id").alias("sales_type_id"))
    return d.sales_by_department.join(enabled, "sales_type_id", "left_semi")


_ACTUALS = """SELECT f.ds - s.start_time_interval AS ds, location_id, sales_type_id,
    coalesce(department_id, 0) AS department_id, y FROM salesd f JOIN sales_type t
    ON t.id = f.sales_type_id AND t.forecast_enabled JOIN shifts s USING (location_id) {join}
    WHERE f.ds BETWEEN TIMESTAMP '2024-01-10' + s.start_time_interval
    AND TIMESTAMP '2024-01-12 23:45' + s.start_time_interval"""


@check("j9_actuals_all_departments", _ACTUALS.format(join=""))
def _(d):
    return clean.actuals_for_forecast(
        d.sales_by_department, d.sales_type, d.shifts, D10, D12
    )


@check(
    "j9_actuals_enabled_departments",
    _ACTUALS.format(join="") + """ AND (department_id IS NULL OR department_id NOT IN
    (SELECT id FROM department WHERE NOT forecast_enabled))""",
)
def _(d):
    return clean.actuals_for_forecast(
        d.sales_by_department, d.sales_type, d.shifts, D10, D12, d.department
    )


@check(
    "j10_start_intervals",
    """SELECT location_id, corporation_id, epoch(start_time_interval)::BIGINT // 60 AS start_minute
    FROM shifts""",
)
def _(d):
    minutes = F.expr(
        "extract(DAY FROM start_time_interval) * 1440 "
        "+ extract(HOUR FROM start_time_interval) * 60 "
        "+ extract(MINUTE FROM start_time_interval)"
    )
    return d.shifts.select(
        "location_id", "corporation_id", minutes.cast("long").alias("start_minute")
    )


@check(
    "j11_missing_weather_dates",
    """SELECT l.postal_code, d::DATE AS weather_date FROM location l
    CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30',
        INTERVAL 1 DAY)) AS d)
    WHERE NOT EXISTS (SELECT 1 FROM weather_daily w WHERE w.postal_code = l.postal_code
        AND w.weather_date = d::DATE)""",
)
def _(d):
    keys = d.location.select("postal_code")
    return gapfill.missing_dates(keys, d.weather_daily, "weather_date", FIRST_DAY, LAST_DAY)


@check("j12_forecast_grid", f"SELECT {K}, corporation_id, level FROM grid")
def _(d):
    return hierarchy.forecast_grid(d.location, d.sales_type, d.department)


_FUTURE = f"""(SELECT {K}, last + s::INT * INTERVAL 15 MINUTE AS ds
    FROM (SELECT {K}, max(ds) AS last FROM panel GROUP BY ALL)
    CROSS JOIN (SELECT unnest(generate_series(1, {HORIZON_DAYS} * 96)) AS s))"""
_FUTURE_CELL = "hour(ds) * 4 + minute(ds) // 15 AS interval_of_day, isodow(ds) - 1 AS dayofweek"


@check(
    "j13_future_profile",
    f"""SELECT ds, {K}, {_PROFILE_SQL}, CASE WHEN interval_zero_rate < 0.8 THEN 1 ELSE 0 END
    AS typical_open FROM (SELECT *, {_FUTURE_CELL} FROM {_FUTURE})
    LEFT JOIN profile USING ({K}, interval_of_day, dayofweek)""",
)
def _(d):
    profile = prof.interval_profile(with_calendar(d.panel))
    future = with_calendar(gapfill.future_slots(d.panel, HORIZON_DAYS))
    joined = prof.attach_profile(future, profile)
    return rounded(joined, *_PROFILE_NAMES).select("ds", *KEYS, *_PROFILE_NAMES, "typical_open")


@check(
    "j14_future_holidays",
    f"""SELECT ds, {K}, CASE WHEN EXISTS (SELECT 1 FROM holiday_days h JOIN location l
        ON l.corporation_id = h.corporation_id AND l.id = f.location_id
        WHERE h.date = f.ds::DATE) THEN 1 ELSE 0 END AS is_holiday FROM {_FUTURE} f""",
)
def _(d):
    future = gapfill.future_slots(d.panel, HORIZON_DAYS)
    dates = hol.holiday_dates(d.holiday, windows=True, by_corporation=True)
    return hol.with_holiday_flag(future, dates, d.location).select("ds", *KEYS, "is_holiday")


_DAILY_JOIN = "panel p JOIN location l ON l.id = p.location_id LEFT JOIN weather_daily w"


@check(
    "j15_daily_weather",
    f"""SELECT p.ds, {K}, {WEATHER_SQL} FROM {_DAILY_JOIN}
    ON w.postal_code = l.postal_code AND w.weather_date = p.ds::DATE""",
)
def _(d):
    rows = wx.with_daily_weather(wx.with_postal_code(d.panel, d.location), d.weather_daily)
    return rounded(rows, *_WX).select("ds", *KEYS, *_WX)


@check(
    "j15_daily_weather_exact",
    f"""SELECT p.ds, {K}, {WEATHER_SQL} FROM {_DAILY_JOIN}
    ON w.postal_code = l.postal_code AND w.weather_date::TIMESTAMP = p.ds""",
)
def _(d):
    postal = wx.with_postal_code(d.panel, d.location)
    rows = wx.with_daily_weather(postal, d.weather_daily, exact=True)
    return rounded(rows, *_WX).select("ds", *KEYS, *_WX)


@check(
    "j16_key_membership",
    """SELECT l.id AS location_id, CASE WHEN l.id IN (SELECT location_id FROM panel) THEN 1
    ELSE 0 END AS in_sales, 1 AS in_locations FROM location l
    UNION ALL SELECT DISTINCT location_id, 1, 0 FROM panel
    WHERE location_id NOT IN (SELECT id FROM location)""",
)
def _(d):
    return key_membership(d.panel, d.location)


@check(
    "j17_weather_zone",
    """SELECT l.id, postal_code, zone, CASE WHEN zone < 'Z5' THEN
    (substr(zone, 2)::INT + 1) / 10.0::DOUBLE END AS real_feel_scale,
    CASE WHEN zone < 'Z5' THEN 5.0::DOUBLE END AS snow_scale
    FROM location l LEFT JOIN postal_zone USING (postal_code)""",
)
def _(d):
    places = d.location.select("id", "postal_code")
    rows = wx.with_weather_zone(places, d.postal_zone, d.zone_scales)
    scales = fn.parse_prior_scales(F.col("prior_scales"))
    return rows.select(
        "id",
        "postal_code",
        "zone",
        scales["real_feel"].alias("real_feel_scale"),
        scales["snow"].alias("snow_scale"),
    )


@check(
    "j18_location_attributes",
    """SELECT c_custkey AS location_id, c_custkey % 5 AS corporation_id,
    10 * (c_custkey % 5) + 5 AS default_sales_type_forecast,
    c_nationkey % 12 AS open_hour, c_nationkey % 12 + 12 AS close_hour FROM customer""",
)
def _(d):
    rows = hierarchy.location_attributes(d.location)
    return rows.select(
        "location_id",
        "corporation_id",
        "default_sales_type_forecast",
        F.col("hours")["open"].alias("open_hour"),
        F.col("hours")["close"].alias("close_hour"),
    )


@check(
    "j19_corporation_members",
    """SELECT corporation_id, 'location' AS kind, id FROM location
    UNION ALL SELECT corporation_id, 'sales_type', id FROM sales_type WHERE forecast_enabled
    UNION ALL SELECT corporation_id, 'department', id FROM department""",
)
def _(d):
    return hierarchy.corporation_members(d.location, d.sales_type, d.department)


# Set operations and re-ingest


@check(
    "u1_union_predictions",
    f"""SELECT ds, {K}, yhat, 'base' AS model FROM pairs
    UNION ALL SELECT ds, {K}, yhat_b, 'second' FROM pairs""",
)
def _(d):
    pairs = d.pairs
    base = pairs.select("ds", *KEYS, "yhat", F.lit("base").alias("model"))
    second = pairs.select("ds", *KEYS, F.col("yhat_b").alias("yhat"))
    second = second.withColumn("model", F.lit("second"))
    return base.unionByName(second)


@check(
    "u2_range_anchors",
    f"""SELECT {K}, min(ds) AS first_ds, max(ds) AS last_ds, count(*) AS slots
    FROM dense GROUP BY ALL""",
)
def _(d):
    return d.dense.groupBy(*KEYS).agg(
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.count(F.lit(1)).alias("slots"),
    )


@check(
    "u3_replace_is_scoped",
    f"""SELECT {K}, count(*) AS n_rows, {sql_r("sum(y)")} AS total
    FROM ({_REPLACED_ACTUALS}) GROUP BY {K}""",
)
def _(d):
    series = d.batch.select(*KEYS).distinct()
    once = overwrite.replace_actuals(d.sales_by_department, d.batch, series, T10, T12)
    twice = overwrite.replace_actuals(once, d.batch, series, T10, T12)
    totals = twice.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("total"))
    return rounded(totals, "total")


@check(
    "m13_reingest_corporation",
    f"""SELECT s.ds, {K}, y FROM salesd s WHERE NOT EXISTS (SELECT 1 FROM grid g
        WHERE g.corporation_id = 2 AND {on("g", "s", "location_id, sales_type_id")}
        AND g.department_id IS NOT DISTINCT FROM s.department_id
        AND s.ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12')
    UNION ALL SELECT b.ds, {K}, y FROM batch b WHERE EXISTS (SELECT 1 FROM grid g
        WHERE g.corporation_id = 2 AND {on("g", "b", "location_id, sales_type_id")}
        AND g.department_id IS NOT DISTINCT FROM b.department_id)""",
)
def _(d):
    store = Store(
        actual=d.sales_by_department,
        location=d.location,
        corporation=d.corporation,
        department=d.department,
        sales_type=d.sales_type,
        weather=d.weather_daily,
        holiday=d.holiday,
    )
    return reingest_actuals(store, d.batch, 2, T10, T12)

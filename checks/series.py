"""Aggregates, windows, ordering, gap filling and scalar functions."""

import datetime as dt

from pyspark.sql import functions as F

from checks.data import FIRST_DAY, LAST_DAY, r, rounded
from checks.registry import check
from checks.sql import K
from checks.sql import r as sql_r
from checks.tables import _PROFILE_NAMES, _PROFILE_SQL, _WX, baseline, payload_sql
from slotcast.functions import calendar as cal
from slotcast.functions import scalars as fn
from slotcast.operators import audit, blend, clean, evaluate, gapfill, publish
from slotcast.operators import holidays as hol
from slotcast.operators import profile as prof
from slotcast.operators import weather as wx
from slotcast.operators import windows as win
from slotcast.operators.features import EVALUATION_FEATURES
from slotcast.operators.median import column_medians, medians_by_column
from slotcast.plans.production import HORIZON_DAYS
from slotcast.schemas import KEYS

D10, D12 = dt.date(2024, 1, 10), dt.date(2024, 1, 12)

# Aggregations


@check(
    "a1_interval_profile",
    f"SELECT {K}, interval_of_day, dayofweek, {_PROFILE_SQL} FROM profile",
)
def _(d):
    return rounded(prof.interval_profile(cal.with_calendar(d.panel)), *_PROFILE_NAMES)


@check(
    "a1_train_only_profile",
    f"""SELECT ds, {K}, {_PROFILE_SQL} FROM (SELECT ds, {K}, rn, n,
        hour(ds) * 4 + minute(ds) // 15 AS interval_of_day, isodow(ds) - 1 AS dayofweek
        FROM z_split) LEFT JOIN (
        SELECT {K}, hour(ds) * 4 + minute(ds) // 15 AS interval_of_day,
        isodow(ds) - 1 AS dayofweek, avg(y) AS interval_mean, median(y) AS interval_median,
        stddev_samp(y) AS interval_std,
        avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS interval_zero_rate
        FROM z_split WHERE rn <= floor(n * 0.8::DOUBLE) GROUP BY ALL)
        USING ({K}, interval_of_day, dayofweek)""",
)
def _(d):
    rows = prof.with_profile(win.with_split(cal.with_calendar(d.dense)), "is_train")
    return rounded(rows, *_PROFILE_NAMES).select("ds", *KEYS, *_PROFILE_NAMES)


_WX_SQL = ", ".join(f"{sql_r(c)} AS {c}" for c in _WX)


@check("a2_hourly_weather", f"SELECT postal_code, hour_floor, {_WX_SQL} FROM hourly_weather")
def _(d):
    return rounded(wx.hourly_weather(d.weather), *_WX)


_DAILY_SLICE = f"""SELECT postal_code, ds::DATE AS ds, {sql_r("avg(real_feel)")} AS real_feel,
    {sql_r("sum(precipitation)")} AS precipitation, {sql_r("avg(coverage)")} AS coverage,
    {sql_r("sum(snow)")} AS snow FROM weather
    WHERE ds BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30'
    AND ds::TIME BETWEEN TIME '06:00' AND TIME '20:00' GROUP BY 1, 2"""


@check("a3_daily_weather_slice", _DAILY_SLICE)
def _(d):
    rows = wx.daily_weather(d.weather, FIRST_DAY, LAST_DAY, 6 * 60, 20 * 60)
    return rounded(rows, *_WX)


_REGRESSORS = f"""SELECT g.postal_code, g.ds, {sql_r("c")} AS comfort_level,
    {sql_r("i")} AS intensity
    FROM (SELECT postal_code, unnest(generate_series(min(ds::DATE)::TIMESTAMP,
            max(ds::DATE)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS ds FROM levels
          WHERE ds BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30'
          AND ds::TIME BETWEEN TIME '10:00' AND TIME '10:30' GROUP BY postal_code) g
    LEFT JOIN (SELECT postal_code, ds::DATE AS ds, avg(comfort_level) / 5 AS c,
            avg(intensity) / 5 AS i FROM levels
          WHERE ds BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30'
          AND ds::TIME BETWEEN TIME '10:00' AND TIME '10:30' GROUP BY ALL) v
    ON v.postal_code = g.postal_code AND v.ds = g.ds"""


@check("a4_daily_regressor_means", _REGRESSORS)
def _(d):
    rows = wx.weather_regressors(d.weather, FIRST_DAY, LAST_DAY, 10 * 60, 10 * 60 + 30)
    return rounded(rows, "comfort_level", "intensity")


@check("a5_series_mae", f"SELECT {K}, {sql_r('mae_15min')} AS mae_15min FROM base_series")
def _(d):
    return rounded(evaluate.series_mae(d.pairs), "mae_15min")


@check("a6_hourly_mae", f"SELECT {K}, {sql_r('mae_hourly')} AS mae_hourly FROM base_series")
def _(d):
    return evaluate.series_scores(d.pairs).select(*KEYS, r("mae_hourly").alias("mae_hourly"))


@check("a7_daily_mae", f"SELECT {K}, {sql_r('mae_daily')} AS mae_daily FROM base_series")
def _(d):
    return evaluate.series_scores(d.pairs).select(*KEYS, r("mae_daily").alias("mae_daily"))


@check("a8_median_mae", f"SELECT grain, {sql_r('mae')} AS mae FROM base_mae")
def _(d):
    return rounded(evaluate.evaluate(d.pairs), "mae")


_IMPROVEMENT = f"""SELECT grain, {sql_r("b.mae")} AS baseline_mae, {sql_r("f.mae")} AS model_mae,
    {sql_r("(b.mae - f.mae) / nullif(b.mae, 0) * 100")} AS improvement_pct
    FROM base_mae b JOIN final_mae f USING (grain)"""


@check("a9_improvement", _IMPROVEMENT)
def _(d):
    pairs = d.pairs
    final = evaluate.evaluate(blend.evaluation_blend(pairs), "yhat_final")
    rows = evaluate.improvement(evaluate.evaluate(pairs), final)
    return rounded(rows, "baseline_mae", "model_mae", "improvement_pct")


@check(
    "a10_location_improvement",
    f"""SELECT location_id, {sql_r("CASE WHEN b > 0 THEN (b - m) / b * 100 ELSE 0 END")}
    AS improvement_pct FROM (SELECT location_id, avg(b) AS b, avg(m) AS m FROM (
        SELECT {K}, avg(abs(y - yhat)) AS b, avg(abs(y - yhat_final)) AS m
        FROM blended GROUP BY ALL) GROUP BY ALL)""",
)
def _(d):
    rows = evaluate.location_improvement(blend.evaluation_blend(d.pairs), "yhat", "yhat_final")
    return rounded(rows, "improvement_pct")


def _zero_sql(column: str) -> str:
    return f"""SELECT '{column}' AS predictor, count(*) FILTER (y = 0) AS actual_zeros,
        count(*) FILTER ({column} = 0) AS predicted_zeros,
        count(*) FILTER (y = 0 AND {column} = 0) AS zero_hits FROM blended"""


@check(
    "a11_zero_precision_recall",
    f"""SELECT *, {sql_r("coalesce(zero_hits / nullif(predicted_zeros, 0), 0)")} AS precision,
    {sql_r("coalesce(zero_hits / nullif(actual_zeros, 0), 0)")} AS recall
    FROM ({_zero_sql("yhat")} UNION ALL {_zero_sql("yhat_final")})""",
)
def _(d):
    final = blend.evaluation_blend(d.pairs)
    return rounded(evaluate.zero_metrics(final, ["yhat", "yhat_final"]), "precision", "recall")


@check(
    "a12_zero_hits",
    """SELECT count(*) FILTER (y = 0) AS actual_zeros,
    count(*) FILTER (y = 0 AND yhat = 0) AS yhat_hits,
    count(*) FILTER (y = 0 AND yhat_b = 0) AS yhat_b_hits FROM pairs""",
)
def _(d):
    return blend.zero_hits(d.pairs, ["yhat", "yhat_b"])


@check("a13_series_keys", f"SELECT DISTINCT {K} FROM panel")
def _(d):
    return prof.series_keys(d.panel)


@check(
    "a14_holiday_dates",
    """SELECT DISTINCT l.id AS location_id, h.ds AS date
    FROM location l JOIN holiday h USING (corporation_id)""",
)
def _(d):
    return hol.holiday_dates(d.holiday, d.location)


@check(
    "a15_first_per_slot",
    f"""SELECT location_id, 10 * location_id + code AS sales_type_id, 0::BIGINT AS department_id,
    ds, min(value) AS y FROM ev GROUP BY ALL""",
)
def _(d):
    raw = d.events.select(
        "ds",
        "location_id",
        (10 * F.col("location_id") + F.col("code")).alias("sales_type_id"),
        F.lit(0).cast("long").alias("department_id"),
        F.col("value").alias("y"),
    )
    return clean.first_per_slot(raw)


@check("a16_forecast_pairs", f"SELECT DISTINCT {K} FROM forecast")
def _(d):
    return publish.forecast_pairs(d.forecast)


_PAYLOAD_TEXT = "array_to_string(list_transform(vals, lambda x: x::VARCHAR), '|')"


@check("a17_day_values", payload_sql(f"date, {_PAYLOAD_TEXT} AS day_values, {K}"))
def _(d):
    rows = publish.business_day_arrays(publish.rounded(d.forecast), d.shifts, D10, D12)
    return rows.select(
        "date", F.array_join(F.col("values").cast("array<string>"), "|").alias("day_values"), *KEYS
    )


_ZERO_RATE = "avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END)"


@check(
    "a18_series_profile",
    f"""SELECT {K}, {sql_r("avg(y)")} AS y_mean, {sql_r("stddev_samp(y)")} AS y_std,
    {sql_r(_ZERO_RATE)} AS y_zero_rate FROM dense GROUP BY {K}""",
)
def _(d):
    return rounded(prof.series_profile(d.dense), "y_mean", "y_std", "y_zero_rate")


_MEDIANS = "SELECT " + ", ".join(f"{sql_r(f'median({c})')} AS {c}" for c in _WX) + " FROM weather"


@check("a19_column_medians", _MEDIANS)
def _(d):
    return rounded(column_medians(d.weather, _WX), *_WX)


@check(
    "a19_column_medians_narrowed",
    " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", {sql_r(f"median({c})")} AS median FROM weather' for c in _WX
    ),
)
def _(d):
    return rounded(medians_by_column(d.weather, _WX, cells=5), "median")


@check(
    "a19_medians_of_unusual_values",
    """SELECT median(v) AS odd, median(v) FILTER (k <> 1) AS even, NULL::DOUBLE AS none
    FROM (SELECT k, CASE WHEN k % 20 = 0 THEN 'NaN'::DOUBLE WHEN k % 20 = 1 THEN '-Infinity'::DOUBLE
        ELSE k END AS v FROM (SELECT real_feel::BIGINT + 45 AS k FROM weather))""",
)
def _(d):
    k = (F.col("real_feel") + 45).cast("long")
    odd = F.when(k % 20 == 0, float("nan")).when(k % 20 == 1, float("-inf")).otherwise(k.cast("double"))
    columns = {
        "odd": odd,
        "even": F.when(k != 1, odd),
        "none": F.lit(None).cast("double"),
    }
    return column_medians(d.weather.select(*[c.alias(n) for n, c in columns.items()]), list(columns))


@check(
    "a20_series_zero_rate",
    f"SELECT ds, {K}, {sql_r(f'{_ZERO_RATE} OVER (PARTITION BY {K})')} AS zero_rate FROM pairs",
)
def _(d):
    rows = prof.with_zero_rate(d.pairs).select("ds", *KEYS, "zero_rate")
    return rounded(rows, "zero_rate")


@check(
    "a21_overview",
    f"""SELECT count(*) AS n_rows, count(DISTINCT ({K})) AS n_series,
    count(DISTINCT location_id) AS n_locations, min(location_id) AS min_location_id,
    max(location_id) AS max_location_id, min(ds) AS min_ds, max(ds) AS max_ds FROM panel""",
)
def _(d):
    return audit.overview(d.panel)


@check(
    "a22_null_counts",
    " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count(*) FILTER ({c} IS NULL) AS nulls FROM salesd'
        for c in ["ds", *KEYS, "y"]
    ),
)
def _(d):
    return audit.null_counts(d.sales_by_department)


@check(
    "a23_rows_per_location",
    "SELECT location_id, count(*) AS n_rows FROM panel GROUP BY ALL ORDER BY location_id",
)
def _(d):
    return audit.rows_per_location(d.panel).orderBy("location_id")


@check(
    "a24_column_types",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS type, count({c}) AS non_null FROM salesd"""
        for c, kind in [("ds", "timestamp_ntz"), *[(k, "bigint") for k in KEYS], ("y", "double")]
    ),
)
def _(d):
    return audit.column_types(d.sales_by_department)


@check(
    "a25_sampled_series",
    f"""SELECT ds, {K}, y FROM panel WHERE substr(md5('7|' || location_id || '|' || sales_type_id
    || '|' || department_id), 1, 8) < '66666666'""",
)
def _(d):
    return clean.sampled_series(d.panel, fraction=0.4, seed=7)


_SHARES = " UNION ALL ".join(
    f"""SELECT {share}::DOUBLE AS share, {K}, count(*) AS n_rows FROM panel
    WHERE ({K}) IN (SELECT ({K}) FROM (SELECT {K}, count(*) OVER () AS n, row_number() OVER (ORDER BY
        md5('7|' || location_id || '|' || sales_type_id || '|' || department_id)) AS place
        FROM (SELECT DISTINCT {K} FROM panel)) WHERE place <= floor(n * {share}::DOUBLE)) GROUP BY ALL"""
    for share in (0.1, 0.5, 0.9)
)


@check("a25_series_sample", _SHARES)
def _(d):
    """Three shares of the series, each of an exact number of whole series."""
    parts = [
        clean.series_sample(d.panel, share, seed=7).groupBy(*KEYS).agg(F.count("*").alias("n_rows"))
        .withColumn("share", F.lit(share))
        for share in (0.1, 0.5, 0.9)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Windows

_LAGS = ", ".join(f"lag(y, {n}) OVER w AS lag_{n}_15min" for n in win.LAGS)
_W = f"WINDOW w AS (PARTITION BY {K} ORDER BY ds)"


def _previous(n: int) -> str:
    return f"OVER (PARTITION BY {K} ORDER BY ds ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _rolling(function: str, name: str) -> str:
    return ", ".join(
        f"{sql_r(f'{function}(y) {_previous(n)}', 5)} AS rolling_{name}_{n}_15min"
        for n in win.ROLLING
    )


_ZERO = "CASE WHEN y = 0 THEN 1 ELSE 0 END"
_ZEROS = ", ".join(
    [f"coalesce(lag({_ZERO}, 1) OVER (PARTITION BY {K} ORDER BY ds), 0) AS prev_was_zero"]
    + [f"sum({_ZERO}) {_previous(n)}::BIGINT AS zeros_in_last_{n}" for n in win.ZERO_WINDOWS]
)


@check("w1_row_lags", f"SELECT ds, {K}, {_LAGS} FROM panel {_W}")
def _(d):
    return d.panel.withColumns(win.lag_columns()).drop("y")


@check("w2_rolling_mean", f"SELECT ds, {K}, {_rolling('avg', 'mean')} FROM panel")
def _(d):
    columns = win.rolling_mean_columns()
    return rounded(d.panel.withColumns(columns).drop("y"), *columns, digits=5)


@check("w3_rolling_std", f"SELECT ds, {K}, {_rolling('stddev_samp', 'std')} FROM panel")
def _(d):
    columns = win.rolling_std_columns()
    return rounded(d.panel.withColumns(columns).drop("y"), *columns, digits=5)


@check("w4_prev_was_zero", f"SELECT ds, {K}, {_ZEROS.split(', sum')[0]} FROM dense")
def _(d):
    column = win.zero_pattern_columns()["prev_was_zero"]
    return d.dense.withColumn("prev_was_zero", column).drop("y")


@check("w5_zero_counts", f"SELECT ds, {K}, {_ZEROS} FROM dense")
def _(d):
    return d.dense.withColumns(win.zero_pattern_columns()).drop("y")


def _same_interval(step: int) -> str:
    lags = ", ".join(f"lag(y, {step * i}) OVER v AS same_interval_lag_{i}_day" for i in range(1, 5))
    return f"""SELECT ds, {K}, {lags} FROM calendar
        WINDOW v AS (PARTITION BY {K}, interval_of_day ORDER BY ds)"""


@check("w6_same_interval_lags", _same_interval(1))
def _(d):
    rows = win.with_same_interval_lags(cal.with_calendar(d.panel))
    return rows.select("ds", *KEYS, *[f"same_interval_lag_{i}_day" for i in range(1, 5)])


@check("w6_same_interval_lags_two_rows", _same_interval(2))
def _(d):
    rows = win.with_same_interval_lags(cal.with_calendar(d.panel), rows_per_day=2)
    return rows.select("ds", *KEYS, *[f"same_interval_lag_{i}_day" for i in range(1, 5)])


@check(
    "w7_chronological_split",
    f"""SELECT ds, {K}, y, rn AS "row", n AS "rows",
    CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 1 ELSE 0 END AS is_train FROM e_split""",
)
def _(d):
    rows = win.with_split(d.panel)
    return rows.withColumn("is_train", F.col("is_train").cast("int"))


@check(
    "w_row_numbers_without_series_window",
    f"""SELECT ds, {K}, y, row_number() OVER (PARTITION BY {K} ORDER BY ds) AS "row",
    count(*) OVER (PARTITION BY {K}) AS "rows" FROM panel""",
)
def _(d):
    return win.number_rows(d.panel)


_HISTORY = f"{_LAGS}, {_rolling('avg', 'mean')}, {_rolling('stddev_samp', 'std')}, {_ZEROS}"


@check("w_history_in_chunks", f"SELECT ds, {K}, y, {_HISTORY} FROM dense {_W}")
def _(d):
    rows = win.in_chunks(d.dense, win.with_history, chunk_rows=700)
    columns = [f"rolling_{k}_{n}_15min" for n in win.ROLLING for k in ("mean", "std")]
    return rounded(rows, *columns, digits=5)


_PARTIAL = "hour minute interval_of_day dayofweek dayofmonth weekofyear is_weekend".split() + [
    *[f"lag_{n}_15min" for n in win.LAGS],
    *[f"rolling_{k}_{n}_15min" for n in win.ROLLING for k in ("mean", "std")],
    "prev_was_zero", "zeros_in_last_4", "zeros_in_last_96",
]


@check(
    "p15_existing_features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS non_null FROM partial_matrix" for c in _PARTIAL
    ),
    partial_matrix=f"SELECT *, {_HISTORY} FROM calendar {_W}",
)
def _(d):
    rows = win.with_history(cal.with_calendar(d.panel))
    names = clean.existing(EVALUATION_FEATURES, rows)
    counts = rows.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "feature", "non_null")


# Ordering


@check(
    "o1_sorted_panel",
    f"""SELECT ds, {K}, y, row_number() OVER (PARTITION BY {K} ORDER BY ds) AS position
    FROM panel""",
)
def _(d):
    return d.panel.withColumn("position", F.row_number().over(win.series_window()))


@check(
    "o2_preview",
    f"SELECT ds, {K}, y, {sql_r('yhat')} AS yhat FROM e_pred ORDER BY {K}, ds LIMIT 10",
)
def _(d):
    return rounded(baseline(d), "yhat").orderBy(*KEYS, "ds").limit(10)


@check(
    "o3_daily_weather_by_date",
    f"""SELECT postal_code, weather_date, {_WX_SQL} FROM weather_daily
    ORDER BY weather_date, postal_code""",
)
def _(d):
    return rounded(d.weather_daily, *_WX).orderBy("weather_date", "postal_code")


@check("o4_sorted_locations", "SELECT DISTINCT location_id FROM panel ORDER BY location_id")
def _(d):
    return d.panel.select("location_id").distinct().orderBy("location_id")


@check(
    "o5_best_weight",
    f"SELECT weight, {sql_r('mae')} AS mae FROM best",
)
def _(d):
    return rounded(blend.best_weight(blend.weight_scores(d.pairs)), "mae")


# Resampling and gap filling


@check("g1_dense_slots", f"SELECT ds, {K}, y FROM dense")
def _(d):
    return d.dense


@check(
    "g2_dense_days",
    f"""SELECT g.postal_code, g.weather_date, {_WX_SQL} FROM (SELECT postal_code,
        unnest(generate_series(min(weather_date)::TIMESTAMP, max(weather_date)::TIMESTAMP,
        INTERVAL 1 DAY))::DATE AS weather_date FROM weather_daily GROUP BY postal_code) g
    LEFT JOIN weather_daily w ON w.postal_code = g.postal_code
        AND w.weather_date = g.weather_date""",
)
def _(d):
    return rounded(gapfill.dense_days(d.weather_daily, "weather_date", ["postal_code"]), *_WX)


@check(
    "g3_date_spine",
    """SELECT id, d::DATE AS date FROM location CROSS JOIN (SELECT unnest(generate_series(
    TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d)""",
)
def _(d):
    return gapfill.date_spine(d.location.select("id"), FIRST_DAY, LAST_DAY)


@check(
    "g4_history_and_future",
    f"""SELECT ds, {K} FROM panel UNION ALL SELECT last + s::INT * INTERVAL 15 MINUTE, {K}
    FROM (SELECT {K}, max(ds) AS last FROM panel GROUP BY ALL)
    CROSS JOIN (SELECT unnest(generate_series(1, {HORIZON_DAYS} * 96)) AS s)""",
)
def _(d):
    return gapfill.history_and_future(d.panel, HORIZON_DAYS)


@check(
    "g5_horizon_coverage",
    """SELECT postal_code, count(weather_date) AS days_found,
    CASE WHEN count(weather_date) < 10 THEN 1 ELSE 0 END AS is_partial
    FROM (SELECT DISTINCT postal_code FROM location) LEFT JOIN (
      SELECT postal_code, weather_date FROM weather_daily
      WHERE weather_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-25') USING (postal_code)
    GROUP BY ALL""",
)
def _(d):
    start = dt.date(2024, 1, 15)
    places = d.location.select("postal_code")
    return gapfill.horizon_coverage(places, d.weather_daily, "weather_date", start, 10)


@check("g6_holiday_windows", "SELECT corporation_id, holiday, day_offset, date FROM holiday_days")
def _(d):
    return hol.holiday_days(d.holiday)


# Scalar functions


def scalar(name: str, sql: str, **columns):
    """A check of column expressions over every event."""

    @check(name, f"SELECT event_id, {sql} FROM events")
    def _(d):
        rows = d.table("events")
        return rows.select("event_id", *[build().alias(n) for n, build in columns.items()])


def ts():
    return F.col("ts")


scalar(
    "f1_hour_minute",
    "hour(ts) AS hour, minute(ts) AS minute",
    hour=lambda: F.hour(ts()),
    minute=lambda: F.minute(ts()),
)
scalar(
    "f2_interval_of_day",
    "hour(ts) * 4 + minute(ts) // 15 AS interval_of_day",
    interval_of_day=lambda: cal.interval_of_day(ts()),
)
scalar("f3_dayofweek", "isodow(ts) - 1 AS dayofweek", dayofweek=lambda: F.weekday(ts()))
scalar("f4_dayofmonth", "day(ts) AS dayofmonth", dayofmonth=lambda: F.dayofmonth(ts()))


@check(
    "f5_weekofyear",
    """SELECT o_orderkey, weekofyear(o_orderdate) AS weekofyear,
    CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM orders""",
)
def _(d):
    date = F.col("o_orderdate")
    return d.table("orders").select(
        "o_orderkey",
        F.weekofyear(date).alias("weekofyear"),
        cal.is_weekend(date).alias("is_weekend"),
    )


scalar(
    "f6_is_weekend",
    "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend",
    is_weekend=lambda: cal.is_weekend(ts()),
)
scalar(
    "f7_hour_start",
    "time_bucket(INTERVAL 1 HOUR, ts) AS hour, time_bucket(INTERVAL 15 MINUTE, ts) AS slot",
    hour=lambda: cal.hour_start(ts()),
    slot=lambda: cal.slot_start(ts()),
)
scalar("f8_date", "ts::DATE AS date", date=lambda: F.to_date(ts()))


@check(
    "f9_abs_error",
    f"""SELECT ds, {K}, {sql_r("abs(y - yhat)")} AS ae, {sql_r("abs(y - yhat_b)")} AS ae_b
    FROM pairs""",
)
def _(d):
    rows = evaluate.with_abs_error(evaluate.with_abs_error(d.pairs), "yhat_b", "ae_b")
    return rounded(rows.select("ds", *KEYS, "ae", "ae_b"), "ae", "ae_b")


@check(
    "f10_typical_open",
    f"""SELECT {K}, interval_of_day, dayofweek,
    CASE WHEN avg({_ZERO}) < 0.8 THEN 1 ELSE 0 END AS typical_open
    FROM (SELECT *, hour(ds) * 4 + minute(ds) // 15 AS interval_of_day,
        isodow(ds) - 1 AS dayofweek FROM dense) GROUP BY {K}, interval_of_day, dayofweek""",
)
def _(d):
    profile = prof.interval_profile(cal.with_calendar(d.dense))
    opened = fn.typical_open(F.col("interval_zero_rate"))
    return profile.select(*KEYS, *prof.CELL, opened.alias("typical_open"))


@check(
    "f11_is_spike",
    f"""SELECT ds, {K}, y, CASE WHEN s > 0 AND y > m + 2 * s THEN 1 ELSE 0 END AS is_spike
    FROM (SELECT *, avg(y) {_previous(96)} AS m, stddev_samp(y) {_previous(96)} AS s FROM dense)""",
)
def _(d):
    rows = win.with_spike(win.with_history(d.dense))
    return rows.select("ds", *KEYS, "y", "is_spike")


_CODES = "coverage_code, intensity_code, weather_code"


@check("f12_code_parts", f"SELECT postal_code, ds, {_CODES} FROM coded")
def _(d):
    return wx.with_weather_codes(d.weather).select("postal_code", "ds", *_CODES.split(", "))


@check("f13_comfort_level", "SELECT postal_code, ds, real_feel, comfort_level FROM levels")
def _(d):
    rows = wx.with_weather_levels(wx.with_weather_codes(d.weather))
    return rows.select("postal_code", "ds", "real_feel", "comfort_level")


@check(
    "f14_intensity_map",
    """SELECT postal_code, ds, intensity_code, CASE intensity_code WHEN 'VL' THEN 1 WHEN 'L' THEN 2
    WHEN 'H' THEN 4 WHEN 'VH' THEN 5 ELSE 1 END AS intensity FROM coded""",
)
def _(d):
    rows = wx.with_weather_codes(d.weather)
    mapped = fn.intensity_level(F.col("intensity_code"), F.lit(""))
    return rows.select("postal_code", "ds", "intensity_code", mapped.alias("intensity"))


@check("f15_intensity_override", "SELECT postal_code, ds, weather_code, intensity FROM levels")
def _(d):
    rows = wx.with_weather_levels(wx.with_weather_codes(d.weather))
    return rows.select("postal_code", "ds", "weather_code", "intensity")


@check(
    "f16_round_forecast",
    f"SELECT ds, {K}, round_even(floor(yhat) / 8, 2) AS yhat FROM forecast",
)
def _(d):
    # Eighths have their third digit at a tie.
    eighths = d.forecast.withColumn("yhat", F.floor("yhat") / 8)
    return publish.rounded(eighths).select("ds", *KEYS, "yhat")


@check(
    "f17_blank_zeros",
    f"SELECT ds, {K}, CASE WHEN y = 0 THEN '' ELSE y::VARCHAR END AS value FROM dense",
)
def _(d):
    blanked = fn.blank_zeros(F.array("y"))[0]
    return d.dense.select("ds", *KEYS, blanked.alias("value"))


scalar(
    "f18_date_text",
    "ts::DATE::VARCHAR AS belongs_to",
    belongs_to=lambda: F.to_date(ts()).cast("string"),
)


@check(
    "f19_json_columns",
    """SELECT c_custkey AS id, c_nationkey % 12 AS open_hour,
    (c_custkey % 5 + 1) / 10.0::DOUBLE AS real_feel_scale FROM customer""",
)
def _(d):
    hours = fn.parse_hours(F.col("hours"))
    scales = F.concat(
        F.lit('{"real_feel":'), ((F.col("corporation_id") + 1) / 10).cast("string"), F.lit("}")
    )
    return d.location.select(
        "id",
        hours["open"].alias("open_hour"),
        fn.parse_prior_scales(scales)["real_feel"].alias("real_feel_scale"),
    )


@check(
    "f20_record_json",
    """SELECT ds, '{"location_id":' || location_id || ',"sales_type_id":' || sales_type_id
    || ',"department_id":' || coalesce(department_id::VARCHAR, 'null') || ',"yhat":'
    || yhat::VARCHAR || '}' AS record FROM forecast""",
)
def _(d):
    return d.forecast.select("ds", fn.record_json(*KEYS, "yhat").alias("record"))


scalar(
    "f21_date_arithmetic",
    """(ts::DATE + INTERVAL 2 DAY)::DATE AS in_two_days, ts::DATE::TIMESTAMP AS midnight,
    ts::DATE + INTERVAL 1425 MINUTE AS last_slot""",
    in_two_days=lambda: F.date_add(F.to_date(ts()), 2),
    midnight=lambda: F.to_date(ts()).cast("timestamp_ntz"),
    last_slot=lambda: cal.slot_time(F.to_date(ts()), F.lit(95)),
)


@check(
    "f22_safe_ratio",
    f"SELECT ds, {K}, {sql_r('coalesce(yhat_b / nullif(y, 0), 0)')} AS ratio FROM pairs",
)
def _(d):
    ratio = fn.safe_ratio(F.col("yhat_b"), F.col("y"))
    return d.pairs.select("ds", *KEYS, r(ratio).alias("ratio"))

"""Forecasting operators and whole runs."""

import datetime as dt

from pyspark.sql import functions as F

from checks.data import LAST_DAY, rounded
from checks.registry import check
from checks.series import _HISTORY, _IMPROVEMENT, _REGRESSORS, _W, _same_interval
from checks.sql import K
from checks.sql import r as sql_r
from checks.tables import _FUTURE, _JOINED, _PROFILE_SQL, _WX, LIMITS, payload_sql
from slotcast import schemas
from slotcast.functions.calendar import moment, with_calendar
from slotcast.operators import audit, blend, boosted, evaluate, features, gapfill, publish
from slotcast.operators import profile as prof
from slotcast.operators import weather as wx
from slotcast.operators import windows as win
from slotcast.operators.baseline import baseline_forecast
from slotcast.operators.ridge import fit_status, ridge_forecast
from slotcast.plans import evaluation, production
from slotcast.plans.panel import Tables
from slotcast.schemas import KEYS, WEATHER_VALUES
from slotcast.sources import snapshots
from slotcast.sources.storage import new_path

D10, D12 = dt.date(2024, 1, 10), dt.date(2024, 1, 12)


def tables(d) -> Tables:
    return Tables(sales=d.sales, weather=d.weather, holiday=d.holiday, location=d.location)


def dense_tables(d) -> Tables:
    return Tables(sales=d.dense, weather=d.weather, holiday=d.holiday, location=d.location)


def store(d) -> production.Store:
    return production.Store(
        actual=d.sales_by_department,
        location=d.location,
        corporation=d.corporation,
        department=d.department,
        sales_type=d.sales_type,
        weather=d.weather_daily,
        holiday=d.holiday,
    )


check_limits = evaluation.Limits(**LIMITS, min_tree_rows=1000)


@check(
    "m1_baseline_forecast",
    f"SELECT ds, {K}, y, {sql_r('yhat')} AS yhat FROM e_pred",
)
def _(d):
    return rounded(baseline_forecast(d.panel, d.labels, **LIMITS), "yhat")


@check(
    "m1_baseline_without_series_windows",
    f"SELECT ds, {K}, y, {sql_r('yhat', 4)} AS yhat FROM z_pred",
)
def _(d):
    rows = baseline_forecast(d.dense, d.labels, whole_series=False)
    return rounded(rows, "yhat", digits=4)


@check("m1_baseline_dense", f"SELECT ds, {K}, y, {sql_r('yhat')} AS yhat FROM z_pred")
def _(d):
    return rounded(baseline_forecast(d.dense, d.labels), "yhat")


@check(
    "m1_baseline_long_daily_scores",
    f"""SELECT {K}, {sql_r("mae_15min")} AS mae_15min, {sql_r("mae_daily")} AS mae_daily
    FROM lsc_series""",
)
def _(d):
    scores = evaluate.series_scores(baseline_forecast(d.long_daily))
    return rounded(scores, "mae_15min", "mae_daily").drop("mae_hourly")


@check("m1_baseline_evaluation", f"SELECT grain, {sql_r('mae')} AS mae FROM esc_mae")
def _(d):
    return rounded(evaluation.baseline_scores(tables(d), check_limits), "mae")


@check("m1_ridge_forecast")
def _(d):
    return ridge_forecast(d.dense, d.labels)


# What must hold for a model whose numbers SQL can't say: a row for every row held out, no gaps,
# ordered intervals, and errors below those of the series' mean.
_HELD_OUT = f"""SELECT {K}, count(*) AS n_rows, 0 AS n_gaps, 0 AS n_unordered, 0 AS n_narrow,
    true AS beats_mean FROM z_pred GROUP BY ALL"""


def _properties(d, rows, share: float = 1.0):
    mean = baseline_forecast(d.dense, d.labels).select(*KEYS, "ds")
    level = d.dense.join(mean, [*KEYS, "ds"], "left_anti").groupBy(*KEYS)
    level = level.agg(F.avg("y").alias("level"))
    gap = F.col("yhat").isNull() | F.isnan("yhat")
    narrow = (F.col("yhat_upper") - F.col("yhat_lower")) <= 0
    error, naive = F.avg(F.abs(F.col("y") - F.col("yhat"))), F.avg(F.abs(F.col("y") - F.col("level")))
    return rows.join(level, KEYS).groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"),
        F.count_if(gap).cast("int").alias("n_gaps"),
        F.count_if(~F.col("yhat").between(F.col("yhat_lower"), F.col("yhat_upper"))).cast("int").alias("n_unordered"),
        F.count_if(narrow).cast("int").alias("n_narrow"),
        (error < share * naive).alias("beats_mean"),
    )


@check("m1_ridge_properties", _HELD_OUT)
def _(d):
    return _properties(d, ridge_forecast(d.dense, d.labels), 1.25)


@check("m3_ridge_properties", _HELD_OUT)
def _(d):
    weathered = wx.with_daily_weather(wx.with_postal_code(d.dense, d.location), d.weather_daily)
    return _properties(d, ridge_forecast(weathered, d.labels, WEATHER_VALUES), 1.25)


@check(
    "m1_interval_widths",
    f"SELECT DISTINCT {K}, true AS widens, true AS covers FROM z_pred",
)
def _(d):
    """Intervals that widen over the horizon and hold most of the values."""
    rows = ridge_forecast(d.dense, d.labels)
    width = F.col("yhat_upper") - F.col("yhat_lower")
    day = F.to_date("ds")
    first, last = day <= dt.date(2024, 1, 25), day >= dt.date(2024, 1, 29)
    inside = F.avg(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double"))
    return rows.groupBy(*KEYS).agg(
        (F.avg(F.when(first, width)) < F.avg(F.when(last, width))).alias("widens"),
        (inside > 0.8).alias("covers"),
    )


@check(
    "m1_fit_status",
    f"""SELECT {K}, n AS n_rows, CASE WHEN n >= 370 THEN 'fitted' ELSE 'too_short' END AS status
    FROM (SELECT {K}, count(*) AS n FROM panel GROUP BY ALL)""",
)
def _(d):
    return fit_status(d.panel, min_rows=370, min_train=1, min_test=1)


@check("m2_boosted_trees")
def _(d):
    return evaluation.tree_predictions(dense_tables(d), check_limits)


@check("m3_ridge_with_weather")
def _(d):
    weathered = wx.with_daily_weather(wx.with_postal_code(d.dense, d.location), d.weather_daily)
    return ridge_forecast(weathered, d.labels, WEATHER_VALUES)


_MATRIX_WX = ", ".join(f"{sql_r(f'w.{c}')} AS {c}" for c in _WX)
_LAG_NAMES = ", ".join(f"same_interval_lag_{i}_day" for i in range(1, 5))
_ROLL_NAMES = [f"rolling_{k}_{n}_15min" for n in win.ROLLING for k in ("mean", "std")]


def _matrix_sql(spike: str, profile: str) -> str:
    return f"""SELECT c.ds, {K}, c.y, c.hour, c.minute, c.interval_of_day, c.dayofweek,
        c.dayofmonth, c.weekofyear, c.is_weekend, h.* EXCLUDE (ds, {K}, y), s.* EXCLUDE (ds, {K}),
        {spike} {_PROFILE_SQL},
        CASE WHEN interval_zero_rate < 0.8 THEN 1 ELSE 0 END AS typical_open, {_MATRIX_WX},
        CASE WHEN c.ds::DATE IN (SELECT x.ds FROM holiday x
            WHERE x.corporation_id = l.corporation_id) THEN 1 ELSE 0 END AS is_holiday
        FROM calendar c JOIN (SELECT ds, {K}, y, {_HISTORY} FROM panel {_W}) h USING (ds, {K})
        JOIN ({_same_interval(1)}) s USING (ds, {K})
        LEFT JOIN {profile} pf USING ({K}, interval_of_day, dayofweek)
        JOIN location l ON l.id = c.location_id
        LEFT JOIN hourly_weather w ON w.postal_code = l.postal_code
            AND w.hour_floor = time_bucket(INTERVAL 1 HOUR, c.ds)"""


_SPIKE = f"""CASE WHEN (stddev_samp(c.y) OVER v96) > 0 AND c.y > avg(c.y) OVER v96
    + 2 * stddev_samp(c.y) OVER v96 THEN 1 ELSE 0 END AS is_spike,"""
_V96 = f" WINDOW v96 AS (PARTITION BY {K} ORDER BY c.ds ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)"


def _matrix(d, **options):
    rows = features.feature_matrix(d.panel, d.location, d.weather, d.holiday, **options)
    rows = rounded(rows, *_ROLL_NAMES, digits=5)
    return rounded(rows, *prof.PROFILE, *_WX).drop("postal_code")


@check("m4_feature_matrix", _matrix_sql(_SPIKE, "profile") + _V96)
def _(d):
    return _matrix(d)


@check("m4_feature_matrix_in_chunks", _matrix_sql(_SPIKE, "profile") + _V96)
def _(d):
    return _matrix(d, chunk_rows=700)


_TRAIN_PROFILE = f"""(SELECT {K}, interval_of_day, dayofweek, avg(y) AS interval_mean,
    median(y) AS interval_median, stddev_samp(y) AS interval_std,
    avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS interval_zero_rate
    FROM calendar JOIN (SELECT ds, {K}, rn, n FROM e_split) USING (ds, {K})
    WHERE rn <= floor(n * 0.8::DOUBLE) GROUP BY ALL)"""


@check("m4_feature_matrix_train_only", _matrix_sql("", _TRAIN_PROFILE))
def _(d):
    split = win.with_split(d.panel)
    rows = features.feature_matrix(
        split, d.location, d.weather, d.holiday, train_only="is_train"
    ).drop("row", "rows", "is_train")
    rows = rounded(rows, *_ROLL_NAMES, digits=5)
    return rounded(rows, *prof.PROFILE, *_WX).drop("postal_code")


_FUTURE_LAGS = ", ".join(f"m AS lag_{n}_15min" for n in win.LAGS)
_FUTURE_ROLL = ", ".join(
    f"m AS rolling_mean_{n}_15min, s AS rolling_std_{n}_15min" for n in win.ROLLING
)


_FUTURE_FEATURES = f"""SELECT f.ds, {K}, hour(ds) AS hour, minute(ds) AS minute, interval_of_day, dayofweek,
    day(ds) AS dayofmonth, weekofyear(ds) AS weekofyear,
    CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend, {_PROFILE_SQL},
    CASE WHEN interval_zero_rate < 0.8 THEN 1 ELSE 0 END AS typical_open,
    {_FUTURE_LAGS}, {_FUTURE_ROLL}, z AS prev_was_zero, z * 4 AS zeros_in_last_4,
    z * 96 AS zeros_in_last_96, 20.0::DOUBLE AS real_feel, 0.0::DOUBLE AS precipitation,
    0.0::DOUBLE AS snow, 0.0::DOUBLE AS coverage,
    CASE WHEN ds::DATE IN (SELECT h.ds FROM holiday h JOIN location l USING (corporation_id)
        WHERE l.id = f.location_id) THEN 1 ELSE 0 END AS is_holiday
    FROM (SELECT *, hour(ds) * 4 + minute(ds) // 15 AS interval_of_day,
        isodow(ds) - 1 AS dayofweek FROM {_FUTURE}) f
    LEFT JOIN profile USING ({K}, interval_of_day, dayofweek)
    JOIN (SELECT {K}, {sql_r("avg(y)")} AS m, {sql_r("stddev_samp(y)")} AS s,
        avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS z FROM panel
        GROUP BY location_id, sales_type_id, department_id) USING ({K})"""


@check("m5_future_features", _FUTURE_FEATURES)
def _(d):
    future = gapfill.future_slots(d.panel, production.HORIZON_DAYS)
    rows = features.future_features(future, d.panel, d.location, d.holiday)
    stats = [f"lag_{n}_15min" for n in win.LAGS] + _ROLL_NAMES
    return rounded(rows, *stats, *prof.PROFILE)


@check("m5_future_frame", _FUTURE_FEATURES)
def _(d):
    """The same rows joined by date before slots are told apart."""
    rows = features.future_frame(d.panel, production.HORIZON_DAYS, d.location, d.holiday)
    stats = [f"lag_{n}_15min" for n in win.LAGS] + _ROLL_NAMES
    return rounded(rows, *stats, *prof.PROFILE)


_CELL = "hour(ds) * 4 + minute(ds) // 15 AS interval_of_day, isodow(ds) - 1 AS dayofweek"
_CELL_OF_DENSE = f"""(SELECT {K}, {_CELL},
    avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zr FROM dense GROUP BY ALL)"""


def _cleaned(smallest: str) -> str:
    return f"""SELECT ds, {K}, CASE WHEN NOT zr < 0.8 OR zr > 0.9 OR yhat_b < {smallest}
        THEN 0.0::DOUBLE ELSE yhat_b END AS yhat_b FROM (SELECT *, {_CELL},
        avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY {K}) AS sr FROM pairs)
        JOIN {_CELL_OF_DENSE} USING ({K}, interval_of_day, dayofweek)"""


def _profiled_pairs(d):
    profile = prof.interval_profile(with_calendar(d.dense))
    return prof.attach_profile(with_calendar(d.pairs), profile)


@check("m6_post_process", _cleaned("CASE WHEN sr > 0.7 THEN 1.0 ELSE 0.5 END"))
def _(d):
    return blend.post_process(_profiled_pairs(d), "yhat_b").select("ds", *KEYS, "yhat_b")


@check("m6_post_process_without_quiet_rule", _cleaned("0.5"))
def _(d):
    rows = blend.post_process(_profiled_pairs(d), "yhat_b", quiet_rule=False)
    return rows.select("ds", *KEYS, "yhat_b")


@check("m7_evaluation_blend", f"SELECT ds, {K}, {sql_r('yhat_final')} AS yhat_final FROM blended")
def _(d):
    rows = blend.evaluation_blend(d.pairs).select("ds", *KEYS, "yhat_final")
    return rounded(rows, "yhat_final")


_PRODUCTION = """CASE WHEN yhat < 1 AND yhat_b < 1 THEN 0.0::DOUBLE
    ELSE 0.2::DOUBLE * yhat + 0.8::DOUBLE * yhat_b END"""


@check("m8_production_blend", f"SELECT ds, {K}, {sql_r(_PRODUCTION)} AS yhat_final FROM pairs")
def _(d):
    rows = blend.production_blend(d.pairs).select("ds", *KEYS, "yhat_final")
    return rounded(rows, "yhat_final")


@check("m9_weight_scores", f"SELECT weight, {sql_r('mae')} AS mae FROM weight_scores")
def _(d):
    return rounded(blend.weight_scores(d.pairs), "mae")


@check(
    "m9_search_blend",
    f"""SELECT ds, {K}, weight, {sql_r("weight * yhat + (1 - weight) * yhat_b")} AS yhat_final
    FROM searched""",
)
def _(d):
    rows = blend.search_blend(d.pairs).select("ds", *KEYS, "weight", "yhat_final")
    return rounded(rows, "yhat_final")


@check(
    "m10_three_grain_evaluation",
    f"""SELECT {K}, {sql_r("mae_15min")} AS mae_15min, {sql_r("mae_hourly")} AS mae_hourly,
    {sql_r("mae_daily")} AS mae_daily FROM final_series""",
)
def _(d):
    scores = evaluate.series_scores(blend.evaluation_blend(d.pairs), "yhat_final")
    return rounded(scores, "mae_15min", "mae_hourly", "mae_daily")


_HALF = "(SELECT * FROM pairs WHERE ds >= TIMESTAMP '2024-01-28')"


@check(
    "m11_baseline_fallback",
    f"""SELECT p.ds, {K}, {sql_r(f'''CASE WHEN p.ds < TIMESTAMP '2024-01-28' THEN yhat
    ELSE {_PRODUCTION} END''')} AS yhat_final FROM pairs p""",
)
def _(d):
    pairs = d.pairs
    model = pairs.filter(F.col("ds") >= moment(dt.date(2024, 1, 28)))
    rows = blend.blend_or_baseline(pairs.drop("yhat_b"), model, "yhat_b")
    return rounded(rows.select("ds", *KEYS, "yhat_final"), "yhat_final")


@check(
    "m12_day_payload",
    payload_sql(
        f"date::VARCHAR AS belongs_to, len(vals) AS n_values, {_JOINED} AS forecasts, {K}"
    ),
)
def _(d):
    rows = publish.day_payload(d.forecast, d.shifts, D10, D12)
    return rows.select(
        "belongs_to",
        F.size("forecasts").cast("long").alias("n_values"),
        F.array_join("forecasts", "|").alias("forecasts"),
        *KEYS,
    )


@check("m14_weather_regressors", _REGRESSORS)
def _(d):
    rows = wx.weather_regressors(d.weather, dt.date(2024, 1, 1), LAST_DAY, 600, 630)
    return rounded(rows, "comfort_level", "intensity")


def _audit_sql() -> str:
    parts = [
        f"SELECT 'overview' AS \"check\", '{name}' AS item, ({value})::VARCHAR AS value FROM salesd"
        for name, value in [
            ("n_rows", "count(*)"),
            ("n_series", f"count(DISTINCT ({K}))"),
            ("n_locations", "count(DISTINCT location_id)"),
            ("min_location_id", "min(location_id)"),
            ("max_location_id", "max(location_id)"),
        ]
    ]
    parts += [
        f"SELECT 'nulls', '{c}', count(*) FILTER ({c} IS NULL)::VARCHAR FROM salesd"
        for c in ["ds", *KEYS, "y"]
    ]
    parts += [
        "SELECT 'rows_per_location', location_id::VARCHAR, count(*)::VARCHAR FROM salesd "
        "GROUP BY location_id",
        "SELECT 'membership', 'only_in_sales', count(DISTINCT location_id)::VARCHAR FROM salesd "
        "WHERE location_id NOT IN (SELECT id FROM location)",
        "SELECT 'membership', 'only_in_locations', count(*)::VARCHAR FROM location "
        "WHERE id NOT IN (SELECT location_id FROM salesd)",
    ]
    kinds = [("ds", "timestamp_ntz"), *[(k, "bigint") for k in KEYS], ("y", "double")]
    parts += [f"SELECT 'types', '{c}', '{kind}'" for c, kind in kinds]
    return " UNION ALL ".join(parts)


@check("m15_audit_report", _audit_sql())
def _(d):
    return audit.audit_report(d.sales_by_department, d.location)


@check("e1_compare_ridge_with_index_baseline")
def _(d):
    ridge = evaluate.evaluate(ridge_forecast(d.dense, d.labels))
    index = evaluate.evaluate(baseline_forecast(d.dense, d.labels))
    return evaluate.comparison_report(ridge, index)


@check("e2_tree_comparison")
def _(d):
    base = baseline_forecast(d.dense, d.labels)
    trees = evaluation.tree_predictions(dense_tables(d), check_limits)
    return evaluation.compare(base, trees)


@check("e2_blend_comparison", _IMPROVEMENT)
def _(d):
    pairs = d.pairs
    rows = evaluation.compare(pairs.drop("yhat_b"), pairs.select("ds", *KEYS, "yhat_b"))
    rows = rows.drop("target_met")
    return rounded(rows, "baseline_mae", "model_mae", "improvement_pct")


@check(
    "e2_best_weight_comparison",
    f"""SELECT grain, weight, {sql_r("b.mae")} AS baseline_mae, {sql_r("f.mae")} AS model_mae,
    {sql_r("(b.mae - f.mae) / nullif(b.mae, 0) * 100")} AS improvement_pct
    FROM base_mae b JOIN searched_mae f USING (grain) CROSS JOIN best""",
)
def _(d):
    pairs = d.pairs
    rows = evaluation.compare_best_weight(
        pairs.drop("yhat_b"), pairs.select("ds", *KEYS, "yhat_b")
    ).drop("target_met")
    return rounded(rows, "baseline_mae", "model_mae", "improvement_pct")


_STATUS = f"""SELECT {K}, n_rows, n_tree_rows, CASE WHEN n_rows = 0 THEN 'no_history'
    WHEN n_rows < 150 THEN 'too_short' WHEN n_tree_rows < 60 THEN 'baseline' ELSE 'blended' END AS status
    FROM (SELECT {K}, count(ds) AS n_rows, greatest(count(ds) - 672, 0) AS n_tree_rows FROM
        (SELECT DISTINCT location_id, sales_type_id, coalesce(department_id, 0) AS department_id FROM grid)
        LEFT JOIN (SELECT f.ds - s.start_time_interval AS ds, location_id, sales_type_id,
            CASE WHEN t.level = 'L' THEN 0 ELSE coalesce(department_id, 0) END AS department_id
            FROM salesd f JOIN sales_type t ON t.id = f.sales_type_id AND t.forecast_enabled
            JOIN shifts s USING (location_id)
            WHERE f.ds BETWEEN TIMESTAMP '2022-02-01' + s.start_time_interval
                AND TIMESTAMP '2024-01-31 23:45' + s.start_time_interval GROUP BY ALL) USING ({K})
        GROUP BY ALL)"""


@check("e3_run_status", _STATUS)
def _(d):
    return production.run_status(store(d), dt.date(2024, 1, 31), min_rows=150, min_tree_rows=60)


@check(
    "e3_stored_run",
    f"""SELECT {K}, 180 AS n_days, 0 AS n_not_positive, true AS as_published FROM ({_STATUS})
    WHERE status <> 'no_history' AND status <> 'too_short'""",
)
def _(d):
    """A run that writes its forecast, payload and status, read back from its folder."""
    folder = new_path(d.spark, "run")
    run_date = dt.date(2024, 1, 31)
    params = boosted.TreeParams(max_iter=2, max_depth=2)
    version = production.run(
        store(d), run_date, folder, min_rows=150, min_tree_rows=60, params=params
    )
    stored = snapshots.read_days(d.spark, f"{folder}/forecast", schemas.FORECAST, version=version)
    status = d.spark.read.parquet(f"{folder}/status/{run_date}").filter("status IN ('baseline', 'blended')")
    kinds = "belongs_to string, forecasts array<string>, location_id long, sales_type_id long, department_id long"
    payload = d.spark.read.schema(kinds).json(f"{folder}/payload/{run_date}")
    sent = payload.groupBy(*KEYS).agg(
        F.count_distinct("belongs_to").alias("days"),
        F.sum(F.size(F.filter("forecasts", lambda x: x != ""))).alias("values"),
    )
    whole = F.count_if(F.bround("yhat", 2) != 0).alias("n")
    bad = F.count_if(~(F.col("yhat") > 0)).cast("int").alias("n_not_positive")
    rows = stored.groupBy(*KEYS).agg(whole, bad)
    joined = status.join(sent, KEYS, "left").join(rows, KEYS, "left")
    return joined.select(
        *KEYS,
        F.coalesce("days", F.lit(0)).cast("int").alias("n_days"),
        F.coalesce("n_not_positive", F.lit(0)).alias("n_not_positive"),
        (F.coalesce("values", F.lit(0)) == F.coalesce("n", F.lit(0))).alias("as_published"),
    )


@check("e3_production_forecast")
def _(d):
    return production.production_forecast(
        store(d),
        run_date=dt.date(2024, 1, 31),
        min_rows=LIMITS["min_rows"],
        min_tree_rows=200,
        keep_warmup=True,
    )

"""The fixture tables and shared steps as SQL, for the oracle."""

import re

K = "location_id, sales_type_id, department_id"

_CODE = (
    "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 "
    "WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END"
)


def r(expression: str, digits: int = 6) -> str:
    return f"(round(({expression}) + 1e-9, {digits}) + 0.0::DOUBLE)"


def on(left: str, right: str, columns: str = K) -> str:
    return " AND ".join(f"{left}.{c} = {right}.{c}" for c in columns.replace(" ", "").split(","))


SLOT = "(hour(ds) * 4 + minute(ds) // 15)"
DOW = "(isodow(ds) - 1)"

CTES = {
    "ev": f"""SELECT ts, value, event_type, user_id, user_id % 5 AS location_id,
        {_CODE} AS code, time_bucket(INTERVAL 15 MINUTE, ts) AS ds FROM events""",
    "sales": """SELECT ds, location_id, 10 * location_id + code AS sales_type_id,
        CAST(NULL AS BIGINT) AS department_id, round(sum(value), 2) AS y
        FROM ev GROUP BY ALL""",
    "salesd": """SELECT ds, location_id, 10 * location_id + code AS sales_type_id,
        CASE WHEN code BETWEEN 2 AND 4
             THEN 100 * location_id + 1 + (user_id // 5) % 2 END AS department_id,
        round(sum(value), 2) AS y FROM ev GROUP BY ALL""",
    "panel": """SELECT ds, location_id, sales_type_id, 0::BIGINT AS department_id, y
        FROM sales""",
    "dense": f"""SELECT g.ds, k.location_id, k.sales_type_id, k.department_id,
        coalesce(p.y, 0.0) AS y
        FROM (SELECT DISTINCT {K} FROM panel) k
        CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00',
            TIMESTAMP '2024-01-30 23:45', INTERVAL 15 MINUTE)) AS ds) g
        LEFT JOIN panel p ON {on("p", "k")} AND p.ds = g.ds""",
    "location": """SELECT c_custkey AS id, c_custkey % 5 AS corporation_id,
        lpad(c_custkey::VARCHAR, 8, '0') AS postal_code,
        10 * (c_custkey % 5) + 5 AS default_sales_type_forecast,
        '{"open": ' || (c_nationkey % 12) || ', "close": ' || (c_nationkey % 12 + 12) || '}'
            AS hours FROM customer""",
    "sales_type": """SELECT DISTINCT 10 * location_id + code AS id,
        location_id AS corporation_id, event_type AS name,
        CASE WHEN code IN (1, 5) THEN 'L' ELSE 'D' END AS level,
        code <> 2 AS forecast_enabled FROM ev""",
    "department": """SELECT 100 * (p_partkey % 5) + 1 + (p_partkey // 5) % 2 AS id,
        p_partkey % 5 AS corporation_id, min(p_brand) AS name,
        1 + (p_partkey // 5) % 2 = 1 AS forecast_enabled
        FROM part GROUP BY ALL""",
    "corporation": """SELECT DISTINCT c_custkey % 5 AS id,
        to_hours(c_custkey % 5) AS start_time_interval FROM customer""",
    "shifts": """SELECT l.id AS location_id, l.corporation_id, c.start_time_interval
        FROM location l JOIN corporation c ON c.id = l.corporation_id""",
    "weather": """SELECT lpad((user_id % 5)::VARCHAR, 8, '0') AS postal_code, ts AS ds,
        (k - 45)::DOUBLE AS real_feel, value / 100 AS precipitation,
        CASE WHEN k < 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS snow,
        k / 100.0::DOUBLE AS coverage,
        CASE event_type WHEN 'click' THEN 'SC:VL:R' WHEN 'error' THEN 'BR:H:RS'
            WHEN 'purchase' THEN 'OV::OV' WHEN 'signup' THEN 'NA:M:CL'
            WHEN 'view' THEN 'DF:VH:FW' END AS weather_code
        FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)""",
    "weather_daily": """SELECT postal_code, ds::DATE AS weather_date,
        avg(real_feel) AS real_feel, sum(precipitation) AS precipitation,
        sum(snow) AS snow, avg(coverage) AS coverage FROM weather
        WHERE ds::DATE NOT IN (DATE '2024-01-10', DATE '2024-01-20') GROUP BY ALL""",
    "busy": """SELECT location_id AS corporation_id, ts::DATE AS d, count(*) AS n,
        count(*) FILTER (code = 5) AS views FROM ev GROUP BY ALL""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY corporation_id ORDER BY n DESC, d) AS p,
        row_number() OVER (PARTITION BY corporation_id ORDER BY n, d) AS q,
        row_number() OVER (PARTITION BY corporation_id ORDER BY d) AS f,
        row_number() OVER (PARTITION BY corporation_id ORDER BY views DESC, d) AS v FROM busy""",
    "holiday": """SELECT corporation_id, d AS ds, 'peak' AS holiday, 1 AS lower_window,
            1 AS upper_window FROM ranked WHERE p = 1
        UNION ALL SELECT corporation_id, d, 'again', 0, 0 FROM ranked WHERE p = 1
        UNION ALL SELECT corporation_id, d, 'quiet', -1, 0 FROM ranked WHERE q = 1
        UNION ALL SELECT corporation_id, d, 'first', -2, 1 FROM ranked WHERE f = 1
        UNION ALL SELECT corporation_id, d, 'viewpeak', 0, 2 FROM ranked WHERE v = 1""",
    "holiday_days": """SELECT corporation_id, holiday, o::INT AS day_offset,
        (ds + o::INT)::DATE AS date FROM (SELECT *, unnest(generate_series(
            -abs(lower_window), upper_window)) AS o FROM holiday)""",
    "holiday_labels": """SELECT l.id AS location_id, h.date, h.holiday_label FROM location l
        JOIN (SELECT corporation_id, date, string_agg(DISTINCT holiday || ':' || day_offset, '+'
                ORDER BY holiday || ':' || day_offset) AS holiday_label
              FROM holiday_days GROUP BY ALL) h USING (corporation_id)""",
    "postal_zone": """SELECT lpad(c_custkey::VARCHAR, 8, '0') AS postal_code,
        'Z' || (c_custkey % 7) AS zone FROM customer""",
    "forecast": "SELECT ds, location_id, sales_type_id, department_id, y AS yhat FROM salesd",
    "batch": """SELECT ds, location_id, sales_type_id, department_id, y * 2 AS y FROM salesd
        WHERE ds BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'""",
    "long_daily": """SELECT ascii(l_returnflag)::BIGINT AS location_id,
        ascii(l_linestatus)::BIGINT AS sales_type_id, 0::BIGINT AS department_id,
        l_shipdate AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY ALL""",
    "calendar": f"""SELECT *, hour(ds) AS hour, minute(ds) AS minute, {SLOT} AS interval_of_day,
        {DOW} AS dayofweek, day(ds) AS dayofmonth, weekofyear(ds) AS weekofyear,
        CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM panel""",
    "profile": f"""SELECT {K}, interval_of_day, dayofweek, avg(y) AS interval_mean,
        median(y) AS interval_median, stddev_samp(y) AS interval_std,
        avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS interval_zero_rate
        FROM calendar GROUP BY ALL""",
    "hourly_weather": """SELECT postal_code, time_bucket(INTERVAL 1 HOUR, ds) AS hour_floor,
        avg(real_feel) AS real_feel, sum(precipitation) AS precipitation, sum(snow) AS snow,
        avg(coverage) AS coverage FROM weather GROUP BY ALL""",
    "coded": """SELECT postal_code, ds, real_feel,
        split_part(weather_code, ':', 1) AS coverage_code,
        split_part(weather_code, ':', 2) AS intensity_code,
        split_part(weather_code, ':', 3) AS weather_code FROM weather""",
    "levels": """SELECT *, CASE WHEN real_feel >= 18 AND real_feel <= 24 THEN 1
            WHEN real_feel >= 10 AND real_feel <= 30 THEN 2
            WHEN real_feel >= 0 AND real_feel <= 35 THEN 3
            WHEN real_feel >= -10 AND real_feel <= 40 THEN 4
            WHEN real_feel < -10 OR real_feel > 41 THEN 5 END AS comfort_level,
        CASE WHEN weather_code IN ('CL', 'FW', 'SC', 'BK') THEN 0 WHEN weather_code = 'OV' THEN 1
            WHEN intensity_code = 'L' THEN 2 WHEN intensity_code = 'H' THEN 4
            WHEN intensity_code = 'VH' THEN 5 ELSE 1 END AS intensity FROM coded""",
}


def baseline_ctes(source: str, prefix: str, labels: bool, limits=(100, 50, 10)) -> dict[str, str]:
    """Steps of the baseline forecast on ``source``; the last one is ``{prefix}_pred``."""
    p = prefix
    factor = "1.0::DOUBLE"
    label = "CAST(NULL AS VARCHAR)"
    label_join = ""
    if labels:
        label = "lb.holiday_label"
        label_join = (
            "LEFT JOIN holiday_labels lb ON lb.location_id = t.location_id AND lb.date = t.ds::DATE"
        )
        factor = f"""coalesce(avg(CASE WHEN is_train AND holiday_label IS NOT NULL
            THEN y / nullif(trend * seasonal, 0) END) OVER (PARTITION BY {K}, holiday_label),
            1.0::DOUBLE)"""
    return {
        f"{p}_split": f"""SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ds) AS rn,
            count(*) OVER (PARTITION BY {K}) AS n FROM {source}""",
        f"{p}_rows": f"""SELECT *, rn <= floor(n * 0.8::DOUBLE) AS is_train,
            (epoch(ds) - min(epoch(ds)) OVER (PARTITION BY {K})) / 86400.0::DOUBLE AS x
            FROM {p}_split WHERE n >= {limits[0]} AND floor(n * 0.8::DOUBLE) >= {limits[1]}
            AND n - floor(n * 0.8::DOUBLE) >= {limits[2]}""",
        f"{p}_fit": f"""SELECT {K}, coalesce(regr_slope(y, x), 0) AS slope, avg(y) AS level,
            avg(x) AS middle FROM {p}_rows WHERE is_train GROUP BY ALL""",
        f"{p}_trend": f"""SELECT t.*, greatest(level + slope * (x - middle), 1.0::DOUBLE) AS trend,
            {label} AS holiday_label, {SLOT.replace("ds", "t.ds")} AS slot,
            {DOW.replace("ds", "t.ds")} AS dow
            FROM {p}_rows t JOIN {p}_fit f ON {on("t", "f")} {label_join}""",
        f"{p}_cell": f"""SELECT {K}, slot, dow, avg(y / trend) AS s FROM {p}_trend
            WHERE is_train GROUP BY ALL""",
        f"{p}_slot": f"""SELECT {K}, slot, avg(y / trend) AS s FROM {p}_trend
            WHERE is_train GROUP BY ALL""",
        f"{p}_series": f"""SELECT {K}, avg(y / trend) AS s FROM {p}_trend
            WHERE is_train GROUP BY ALL""",
        f"{p}_seasonal": f"""SELECT t.*, coalesce(c.s, o.s, a.s) AS seasonal FROM {p}_trend t
            LEFT JOIN {p}_cell c ON {on("t", "c", K + ", slot, dow")}
            LEFT JOIN {p}_slot o ON {on("t", "o", K + ", slot")}
            LEFT JOIN {p}_series a ON {on("t", "a")}""",
        f"{p}_factor": f"SELECT *, {factor} AS factor FROM {p}_seasonal",
        f"{p}_pred": f"""SELECT ds, {K}, y, trend * seasonal * factor AS yhat
            FROM {p}_factor WHERE NOT is_train""",
    }


CTES |= baseline_ctes("dense", "z", labels=True)
CTES |= baseline_ctes("panel", "e", labels=True, limits=(20, 10, 4))
CTES |= baseline_ctes("long_daily", "l", labels=False)
CTES["pairs"] = f"""SELECT p.ds, p.location_id, p.sales_type_id, p.department_id, p.y,
    {r("p.yhat")} AS yhat, b.yhat_b FROM z_pred p
    JOIN (SELECT ds, {K}, round(avg(y) OVER (PARTITION BY {K} ORDER BY ds
            ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) + 1e-9, 6) AS yhat_b FROM dense) b
    ON {on("p", "b", K + ", ds")}"""


def scores_ctes(source: str, yhat: str, prefix: str) -> dict[str, str]:
    """Three-grain scores of ``source``; ``{prefix}_series`` and ``{prefix}_mae``."""
    p = prefix
    parts = []
    for grain, bucket in [("hourly", "time_bucket(INTERVAL 1 HOUR, ds)"), ("daily", "ds::DATE")]:
        parts.append(
            f"""(SELECT {K}, avg(e) AS mae_{grain} FROM (SELECT {K}, {bucket} AS b,
            abs(sum(y) - sum({yhat})) AS e FROM {source} GROUP BY ALL) GROUP BY ALL)"""
        )
    return {
        f"{p}_series": f"""SELECT * FROM (SELECT {K}, avg(abs(y - {yhat})) AS mae_15min
            FROM {source} GROUP BY ALL) JOIN {parts[0]} USING ({K}) JOIN {parts[1]} USING ({K})""",
        f"{p}_med": f"""SELECT median(mae_15min) AS a, median(mae_hourly) AS b,
            median(mae_daily) AS c FROM {p}_series""",
        f"{p}_mae": f"""SELECT '15min' AS grain, a AS mae FROM {p}_med
            UNION ALL SELECT 'hourly', b FROM {p}_med UNION ALL SELECT 'daily', c FROM {p}_med
            UNION ALL SELECT 'combined', (a + b + c) / 3 FROM {p}_med""",
    }


CTES["blended"] = """SELECT *, CASE WHEN (yhat < 1 AND yhat_b < 1) OR (yhat_b = 0 AND yhat < 2)
    THEN 0.0::DOUBLE ELSE 0.15::DOUBLE * yhat + 0.85::DOUBLE * yhat_b END AS yhat_final
    FROM pairs"""
CTES |= scores_ctes("pairs", "yhat", "base")
CTES |= scores_ctes("blended", "yhat_final", "final")
CTES |= scores_ctes("e_pred", "yhat", "esc")
CTES |= scores_ctes("l_pred", "yhat", "lsc")
_WEIGHTED = " UNION ALL ".join(
    f"""SELECT {w}::DOUBLE AS weight, median(e) AS mae FROM (SELECT {K},
    avg(abs(y - ({w}::DOUBLE * yhat + (1 - {w}::DOUBLE) * yhat_b))) AS e FROM pairs GROUP BY ALL)"""
    for w in (0.1, 0.2, 0.3, 0.4, 0.5)
)
CTES["weight_scores"] = _WEIGHTED
CTES["best"] = "SELECT weight, mae FROM weight_scores ORDER BY mae, weight LIMIT 1"
CTES["searched"] = """SELECT p.*, weight, weight * yhat + (1 - weight) * yhat_b AS yhat_final
    FROM pairs p CROSS JOIN (SELECT weight FROM best)"""
CTES |= scores_ctes("searched", "yhat_final", "searched")
CTES["grid"] = """SELECT l.id AS location_id, t.id AS sales_type_id,
        CAST(NULL AS BIGINT) AS department_id, l.corporation_id, t.level FROM location l
        JOIN sales_type t USING (corporation_id) WHERE t.forecast_enabled AND t.level = 'L'
    UNION ALL SELECT l.id, t.id, d.id, l.corporation_id, t.level FROM location l
        JOIN sales_type t USING (corporation_id) JOIN department d USING (corporation_id)
        WHERE t.forecast_enabled AND t.level = 'D'"""


def query(body: str, **extra: str) -> str:
    """``body`` with the steps it needs in front, each before its first use."""
    known = {**CTES, **extra}
    names = re.compile(r"\b(" + "|".join(sorted(known, key=len, reverse=True)) + r")\b")
    needed: dict[str, None] = {}

    def visit(text: str, seen: tuple) -> None:
        for name in dict.fromkeys(names.findall(text)):
            if name not in needed and name not in seen:
                visit(known[name], (*seen, name))
                needed[name] = None

    visit(body, ())
    steps = ",\n".join(f"{name} AS ({known[name]})" for name in needed)
    return f"WITH {steps}\n{body}" if steps else body

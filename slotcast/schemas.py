"""Explicit schemas; nothing in this package infers one."""

from pyspark.sql import types as T

KEYS = ["location_id", "sales_type_id", "department_id"]

SLOT_MINUTES = 15
SLOTS_PER_DAY = 96

_key_fields = [
    T.StructField("location_id", T.LongType()),
    T.StructField("sales_type_id", T.LongType()),
    T.StructField("department_id", T.LongType()),
]
_ds = T.StructField("ds", T.TimestampNTZType())
WEATHER_VALUES = ["real_feel", "precipitation", "snow", "coverage"]
_weather_fields = [T.StructField(name, T.DoubleType()) for name in WEATHER_VALUES]

SALES = T.StructType([_ds, *_key_fields, T.StructField("y", T.DoubleType())])

FORECAST = T.StructType([_ds, *_key_fields, T.StructField("yhat", T.DoubleType())])

PREDICTION = T.StructType(
    [_ds, T.StructField("y", T.DoubleType()), T.StructField("yhat", T.DoubleType()), *_key_fields]
)

WEATHER = T.StructType([T.StructField("postal_code", T.StringType()), _ds, *_weather_fields])

WEATHER_HOURLY = T.StructType([*WEATHER.fields, T.StructField("weather_code", T.StringType())])

WEATHER_DAILY = T.StructType(
    [
        T.StructField("postal_code", T.StringType()),
        T.StructField("weather_date", T.DateType()),
        *_weather_fields,
    ]
)

HOLIDAY = T.StructType(
    [
        T.StructField("corporation_id", T.LongType()),
        T.StructField("ds", T.DateType()),
        T.StructField("holiday", T.StringType()),
        T.StructField("lower_window", T.IntegerType()),
        T.StructField("upper_window", T.IntegerType()),
    ]
)

# Postal codes keep leading zeros and letters, so they are strings everywhere.
LOCATION_CSV = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("corporation_id", T.LongType()),
        T.StructField("postal_code", T.StringType()),
    ]
)

LOCATION = T.StructType(
    [
        *LOCATION_CSV.fields,
        T.StructField("default_sales_type_forecast", T.LongType()),
        T.StructField("hours", T.StringType()),
    ]
)

CORPORATION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("start_time_interval", T.DayTimeIntervalType()),
    ]
)

DEPARTMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("corporation_id", T.LongType()),
        T.StructField("name", T.StringType()),
    ]
)

SALES_TYPE = T.StructType([*DEPARTMENT.fields, T.StructField("level", T.StringType())])

HOURS = T.MapType(T.StringType(), T.IntegerType())

PRIOR_SCALES = T.MapType(T.StringType(), T.DoubleType())

# One baseline score per grain, as stored in the metrics document.
METRICS = T.StructType(
    [T.StructField(grain, T.DoubleType()) for grain in ("15min", "hourly", "daily", "combined")]
)

_by_grain = T.MapType(T.StringType(), T.DoubleType())
_zero_rates = T.StructType(
    [T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType())]
)
COMPARISON = T.StructType(
    [
        T.StructField("baseline_mae", _by_grain),
        T.StructField("model_mae", _by_grain),
        T.StructField("improvement_pct", _by_grain),
        T.StructField("zero_metrics", T.MapType(T.StringType(), _zero_rates)),
    ]
)

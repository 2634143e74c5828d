import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotcast.functions import calendar as cal
from slotcast.functions import scalars as fn


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_comfort_bands(spark):
    expected = {
        -11.0: 5, -10.0: 4, -0.5: 4, 0.0: 3, 9.5: 3, 10.0: 2, 18.0: 1, 24.0: 1, 24.5: 2, 30.0: 2,
        31.0: 3, 35.0: 3, 40.0: 4, 40.5: None, 41.0: None, 42.0: 5, None: None,
    }
    got = values(
        spark, [(x,) for x in expected], "x double", level=fn.comfort_level(F.col("x"))
    )
    assert [g[0] for g in got] == list(expected.values())


def test_intensity(spark):
    rows = [
        ("VL", "R", 1), ("L", "R", 2), ("M", "R", 1), ("H", "RS", 4), ("VH", "R", 5),
        ("", "R", 1), (None, "R", 1), ("H", "CL", 0), ("H", "FW", 0), ("H", "SC", 0),
        ("H", "BK", 0), ("H", "OV", 1), ("H", None, 4),
    ]
    level = fn.intensity_level(F.col("i"), F.col("w"))
    got = values(spark, rows, "i string, w string, e int", level=level, e=F.col("e"))
    assert all(a == b for a, b in got)


def test_code_part_missing_field_is_empty(spark):
    part = fn.code_part(F.col("c"), 3)
    rows = [("A:B:C",), ("A::C",), ("A",), (None,)]
    assert values(spark, rows, "c string", p=part) == [("C",), ("C",), ("",), (None,)]


def test_lower_window_and_ratio(spark):
    got = values(
        spark,
        [(2, 0.0), (-2, 4.0), (0, None)],
        "w int, d double",
        w=fn.non_positive(F.col("w")),
        r=fn.safe_ratio(F.lit(1.0), F.col("d")),
    )
    assert got == [(-2, 0.0), (-2, 0.25), (0, 0.0)]


def test_belongs_to_boundary(spark):
    rows = [(dt.datetime(2024, 1, 2, 3, 45),), (dt.datetime(2024, 1, 2, 4, 0),)]
    shift = F.expr("INTERVAL '4' HOUR")
    got = values(spark, rows, "ds timestamp_ntz", b=cal.belongs_to_time(F.col("ds"), shift))
    assert got == [(dt.datetime(2024, 1, 1, 3, 45),), (dt.datetime(2024, 1, 2, 4, 0),)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_calendar_ignores_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:20 does not exist in New York on this date.
        rows = [(dt.datetime(2024, 3, 10, 2, 20, 7),)]
        ds = F.col("ds")
        got = values(
            spark,
            rows,
            "ds timestamp_ntz",
            hour=cal.hour_start(ds),
            slot=cal.slot_start(ds),
            number=cal.interval_of_day(ds),
            index=cal.slot_index(ds),
            literal=cal.moment(dt.datetime(2024, 3, 10, 2, 30)),
            back=cal.slot_time(F.to_date(ds), cal.interval_of_day(ds)),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    days = (dt.date(2024, 3, 10) - dt.date(1970, 1, 1)).days
    slot = dt.datetime(2024, 3, 10, 2, 15)
    assert got == [(dt.datetime(2024, 3, 10, 2), slot, 9, days * 96 + 9,
                    dt.datetime(2024, 3, 10, 2, 30), slot)]


def test_business_range_covers_96_slots(spark):
    first, last = cal.business_range(
        dt.date(2024, 1, 1), dt.date(2024, 1, 1), F.expr("INTERVAL '4' HOUR")
    )
    got = spark.range(1).select(first.alias("a"), last.alias("b")).first()
    assert (got.b - got.a) == dt.timedelta(minutes=95 * 15)
    assert got.a == dt.datetime(2024, 1, 1, 4)


def test_blank_zeros(spark):
    got = spark.range(1).select(fn.blank_zeros(F.array(F.lit(0.0), F.lit(1.5))).alias("v")).first()
    assert got.v == ["", "1.5"]

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotcast.functions.calendar import with_calendar
from slotcast.operators import profile as prof
from slotcast.operators import windows as win
from slotcast.schemas import KEYS, SALES


@pytest.mark.parametrize("n, train", [(10, 8), (13, 10), (1, 0), (5, 4)])
def test_split_truncates(series, n, train):
    rows = win.with_split(series(range(n))).collect()
    assert sum(r.is_train for r in rows) == train
    order = [r.is_train for r in sorted(rows, key=lambda r: r.ds)]
    assert order == sorted(order, reverse=True)


def test_first_and_second_row(series):
    rows = win.with_history(series([0, 5, 7])).orderBy("ds").collect()
    first, second, third = rows
    assert first.rolling_mean_4_15min is None and first.zeros_in_last_4 is None
    assert first.prev_was_zero == 0
    assert second.rolling_mean_4_15min == 0 and second.rolling_std_4_15min is None
    assert second.prev_was_zero == 1 and second.zeros_in_last_96 == 1
    assert third.rolling_std_4_15min == pytest.approx(np.std([0, 5], ddof=1))


def expected_history(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame.sort_values([*KEYS, "ds"]).reset_index(drop=True)
    shifted = out.groupby(KEYS)["y"].shift(1)
    grouped = shifted.groupby([out[k] for k in KEYS])
    for n in win.LAGS:
        out[f"lag_{n}_15min"] = out.groupby(KEYS)["y"].shift(n)
    for n in win.ROLLING:
        rolling = grouped.rolling(n, min_periods=1)
        out[f"rolling_mean_{n}_15min"] = rolling.mean().reset_index(drop=True)
        out[f"rolling_std_{n}_15min"] = rolling.std().reset_index(drop=True)
    zero = (shifted == 0).astype(float).where(shifted.notna())
    for n in win.ZERO_WINDOWS:
        counts = zero.groupby([out[k] for k in KEYS]).rolling(n, min_periods=1).sum()
        out[f"zeros_in_last_{n}"] = counts.reset_index(drop=True)
    return out


def random_panel(seed: int, series: int = 4, rows: int = 900) -> pd.DataFrame:
    """Sparse series of different length, with zeros."""
    rng = np.random.default_rng(seed)
    parts = []
    for s in range(series):
        n = int(rng.integers(1, rows))
        slots = np.sort(rng.choice(3 * rows, n, replace=False))
        y = np.round(rng.gamma(2, 10, n), 2) * (rng.random(n) > 0.3)
        ds = pd.Timestamp("2024-01-01") + pd.to_timedelta(15 * slots, unit="min")
        parts.append(
            pd.DataFrame(
                {"ds": ds, "location_id": s % 2, "sales_type_id": s, "department_id": 0, "y": y}
            )
        )
    return pd.concat(parts, ignore_index=True)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000))
def test_history_matches_pandas(spark, seed):
    frame = random_panel(seed)
    panel = to_spark(spark, frame)
    want = expected_history(frame)
    for got in (
        win.with_history(panel),
        win.in_chunks(panel, win.with_history, chunk_rows=672),
    ):
        got = got.toPandas().sort_values([*KEYS, "ds"]).reset_index(drop=True)
        assert len(got) == len(want)
        for column in want.columns:
            if column in ("ds", *KEYS):
                assert (got[column] == want[column]).all()
            else:
                np.testing.assert_allclose(
                    got[column].astype(float), want[column].astype(float), atol=1e-7
                )


def to_spark(spark, frame):
    return spark.createDataFrame(frame, SALES)


def test_constant_values_have_no_deviation(series):
    rows = win.with_history(series([0.1] * 300)).orderBy("ds").collect()
    assert all(r.rolling_std_96_15min == 0 for r in rows[2:])
    assert rows[150].rolling_mean_96_15min == pytest.approx(0.1)


def test_missing_values_are_skipped(series):
    rows = win.with_history(series([None] * 10 + [2, 4, None, 0])).orderBy("ds").collect()
    assert rows[5].rolling_mean_96_15min is None
    last = rows[-1]
    assert last.rolling_mean_96_15min == 3 and last.rolling_std_96_15min == pytest.approx(2**0.5)
    assert last.zeros_in_last_96 == 0


def test_row_numbers_match_window(spark):
    panel = to_spark(spark, random_panel(3))
    both = win.number_rows(panel).withColumn(
        "want", F.row_number().over(win.series_window())
    )
    assert both.filter("row <> want").count() == 0


def test_chunk_shorter_than_look_back_is_refused(series):
    with pytest.raises(ValueError):
        win.in_chunks(series([1, 2]), win.with_history, chunk_rows=100)


def test_same_interval_lag_is_one_day(spark, series):
    panel = with_calendar(series(range(96 * 6)))
    rows = win.with_same_interval_lags(panel).filter("y >= 480").collect()
    assert all(r.same_interval_lag_1_day == r.y - 96 for r in rows)
    assert all(r.same_interval_lag_4_day == r.y - 4 * 96 for r in rows)


def test_lags_count_rows_not_time(sales):
    start = dt.datetime(2024, 1, 1)
    panel = sales([(start + dt.timedelta(days=3 * i), 1, 10, 0, float(i)) for i in range(5)])
    rows = win.with_history(panel).orderBy("ds").collect()
    assert [r.lag_4_15min for r in rows] == [None] * 4 + [0.0]


def test_train_only_profile_ignores_test_rows(spark):
    frame = random_panel(11)
    split = win.with_split(with_calendar(to_spark(spark, frame)))
    changed = split.selectExpr(
        "* EXCEPT (y)", "CASE WHEN is_train THEN y ELSE y * 7 + 1 END AS y"
    )
    columns = [*KEYS, "ds", *prof.PROFILE, "typical_open"]
    a = prof.with_profile(split, "is_train").select(columns)
    b = prof.with_profile(changed, "is_train").select(columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_profile_window_equals_join(spark):
    panel = with_calendar(to_spark(spark, random_panel(5)))
    columns = [*KEYS, "ds", "interval_median", "typical_open"]
    a = prof.with_profile(panel).select(columns)
    b = prof.attach_profile(panel, prof.interval_profile(panel)).select(columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

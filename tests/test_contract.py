import pytest

import __spark_entry__ as contract
from checks.compare import compare

# One query per area; `python -m checks.compare <folder>` runs them all.
SAMPLE = [
    "s1_read_sales_csv", "s7_gzip_csv_to_parquet", "s10_read_metrics_json",
    "k1_write_predictions", "k3_replace_actuals", "k4_replace_forecasts", "k5_day_payload_json",
    "k6_comparison_report", "p7_task_series", "p9_time_of_day", "p11_belongs_to_shift",
    "p14_fill_median", "j3_hourly_weather", "j9_actuals_enabled_departments",
    "j12_forecast_grid", "j17_weather_zone", "a1_interval_profile", "a8_median_mae",
    "a10_location_improvement", "a11_zero_precision_recall", "a19_column_medians_narrowed",
    "a25_sampled_series", "w_history_in_chunks", "w6_same_interval_lags", "o5_best_weight",
    "g1_dense_slots", "g4_history_and_future", "g6_holiday_windows", "f13_comfort_level",
    "f20_record_json", "m1_baseline_dense", "m4_feature_matrix", "m5_future_features",
    "m6_post_process", "m9_search_blend", "m12_day_payload", "m13_reingest_corporation",
    "m14_weather_regressors", "m15_audit_report",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, folder, name):
    assert compare(spark, folder, [name])[name].startswith("ok")


def test_entry_has_rows(spark):
    rows = contract.entry(spark).collect()
    assert {r.grain for r in rows} == {"15min", "hourly", "daily", "combined"}


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())

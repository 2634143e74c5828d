"""Scalar column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotcast.schemas import HOURS, PRIOR_SCALES

# Fixed values of the weather code tables.
INTENSITY_LEVELS = {"VL": 1, "L": 2, "H": 4, "VH": 5}
DEFAULT_INTENSITY = 1
CLEAR_SKY_CODES = ["CL", "FW", "SC", "BK"]
OVERCAST_CODE = "OV"
# Comfort level -> ranges of felt temperature as (low, low included, high, high included).
# The first level that matches wins; (40, 41] belongs to none.
COMFORT_RANGES = [
    (1, [(18, True, 24, True)]),
    (2, [(10, True, 18, False), (24, False, 30, True)]),
    (3, [(0, True, 10, False), (30, False, 35, True)]),
    (4, [(-10, True, 0, True), (35, False, 40, True)]),
    (5, [(None, False, -10, False), (41, False, None, False)]),
]
# Fixed thresholds of the open and spike flags.
OPEN_ZERO_RATE = 0.8
SPIKE_DEVIATIONS = 2


def abs_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def safe_ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Ratio, or ``default`` when the denominator is zero or missing."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default))


def is_zero(value: Column) -> Column:
    """1 when the value is zero, else 0; a missing value is not zero."""
    return F.coalesce((value == 0).cast("int"), F.lit(0))


def typical_open(zero_rate: Column) -> Column:
    return F.coalesce((zero_rate < OPEN_ZERO_RATE).cast("int"), F.lit(0))


def is_spike(value: Column, mean: Column, std: Column) -> Column:
    above = (std > 0) & (value > mean + SPIKE_DEVIATIONS * std)
    return F.coalesce(above.cast("int"), F.lit(0))


def non_positive(window: Column) -> Column:
    """A holiday's lower window counts days before it, so it must not be positive."""
    return F.when(window > 0, -window).otherwise(window)


def code_part(code: Column, position: int) -> Column:
    """One field of ``coverage:intensity:weather``; an absent field is ``''``."""
    return F.split_part(code, F.lit(":"), F.lit(position))


def comfort_level(real_feel: Column) -> Column:
    def within(low, low_included, high, high_included):
        above = F.lit(True)
        if low is not None:
            above = real_feel >= low if low_included else real_feel > low
        below = F.lit(True)
        if high is not None:
            below = real_feel <= high if high_included else real_feel < high
        return above & below

    return F.coalesce(
        *[
            F.when(within(*bounds), F.lit(level))
            for level, ranges in COMFORT_RANGES
            for bounds in ranges
        ]
    )


def intensity_level(intensity_code: Column, weather_code: Column) -> Column:
    by_code = F.create_map(*[F.lit(x) for pair in INTENSITY_LEVELS.items() for x in pair])
    return (
        F.when(weather_code == OVERCAST_CODE, F.lit(1))
        .when(weather_code.isin(CLEAR_SKY_CODES), F.lit(0))
        .otherwise(F.coalesce(F.try_element_at(by_code, intensity_code), F.lit(DEFAULT_INTENSITY)))
    )


def parse_hours(hours: Column) -> Column:
    return F.from_json(hours, HOURS)


def parse_prior_scales(scales: Column) -> Column:
    return F.from_json(scales, PRIOR_SCALES)


def blank_zeros(values: Column) -> Column:
    """Array of doubles to array of strings, zero as the empty string."""
    return F.transform(values, lambda v: F.when(v == 0, F.lit("")).otherwise(v.cast("string")))


def record_json(*columns: str) -> Column:
    """One row as a JSON object; NULL fields stay visible."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

"""Row windows per series: lags, rolling statistics, zero patterns, split.

Lags count rows, not time. All functions with the same ``keys`` share one
exchange and one sort.

A series that passed ``first_per_slot`` has at most 96 rows a day, so a window
over a whole series holds about 35,000 rows per year. For panels without such a
bound ``in_chunks`` runs the same functions over row ranges of fixed size.
"""

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slotcast.functions.scalars import is_spike, is_zero
from slotcast.schemas import KEYS

# Row lags, rolling windows and zero-count windows of the feature set.
LAGS = [1, 4, 8, 96, 672]
ROLLING = [4, 8, 96]
ZERO_WINDOWS = [4, 96]
SAME_INTERVAL_DAYS = 4
# Rows per block from which longer rolling windows are merged, and the share of the
# mean below which a merged deviation is rounding error.
BLOCK = 8
ROUNDING = 1e-12
TRAIN_SHARE = 0.8


def series_window(keys: list[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ds")


def previous(n: int, keys: list[str] = KEYS) -> WindowSpec:
    """The ``n`` rows before the current one."""
    return series_window(keys).rowsBetween(-n, -1)


def lag_columns(lags: list[int] = LAGS, keys: list[str] = KEYS) -> dict[str, Column]:
    return {f"lag_{n}_15min": F.lag("y", n).over(series_window(keys)) for n in lags}


def rolling_mean_columns(
    windows: list[int] = ROLLING, keys: list[str] = KEYS
) -> dict[str, Column]:
    return {f"rolling_mean_{n}_15min": F.avg("y").over(previous(n, keys)) for n in windows}


def rolling_std_columns(windows: list[int] = ROLLING, keys: list[str] = KEYS) -> dict[str, Column]:
    """Sample deviation; NULL with fewer than two rows."""
    return {f"rolling_std_{n}_15min": F.stddev_samp("y").over(previous(n, keys)) for n in windows}


def zero_pattern_columns(
    windows: list[int] = ZERO_WINDOWS, keys: list[str] = KEYS
) -> dict[str, Column]:
    """Whether the previous row was zero, and zeros among the previous rows (NULL if none)."""
    zero = is_zero(F.col("y"))
    columns = {"prev_was_zero": F.coalesce(F.lag(zero, 1).over(series_window(keys)), F.lit(0))}
    for n in windows:
        columns[f"zeros_in_last_{n}"] = F.sum(zero).over(previous(n, keys))
    return columns


def with_history(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """All lags, rolling statistics and zero patterns.

    A frame is evaluated anew for every row, which makes the day-long window the
    most expensive one. Here only the short windows are frames; the long one is put
    together from the ``BLOCK``-row statistics of earlier rows.
    """
    short = [n for n in ROLLING if n <= BLOCK]
    block = previous(BLOCK, keys)
    df = df.withColumns(
        {
            **lag_columns(keys=keys),
            **rolling_mean_columns(short, keys),
            **rolling_std_columns(short, keys),
            **zero_pattern_columns([n for n in ZERO_WINDOWS if n <= BLOCK], keys),
            "_rows": F.count("y").over(block),
            "_mean": F.avg("y").over(block),
            "_variance": F.var_pop("y").over(block),
            "_zeros": F.sum(is_zero(F.col("y"))).over(block),
        }
    )
    for n in ROLLING:
        if n > BLOCK:
            df = _with_merged_blocks(df, n, keys)
    return df.drop(*_STATISTICS)


_STATISTICS = ["_rows", "_mean", "_variance", "_zeros"]


def _with_merged_blocks(df: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """Mean, deviation and zeros of the previous ``window`` rows, a multiple of ``BLOCK``.

    Merging a few blocks at a time keeps the generated code of each step small
    enough to be compiled. A deviation within rounding of equal values is 0.
    """
    size = BLOCK
    df = df.withColumns({f"{name}_all": F.col(name) for name in _STATISTICS})
    while size < window:
        count = next(c for c in (4, 3, 2, window // size) if window // size % c == 0)
        df = _merge(df, size, count, keys)
        size *= count
    rows, variance = F.col("_rows_all"), F.col("_variance_all")
    std = F.sqrt(variance * F.try_divide(rows, rows - 1))
    std = F.when(std > F.abs("_mean_all") * ROUNDING, std).otherwise(F.lit(0.0))
    columns = {
        f"rolling_mean_{window}_15min": F.col("_mean_all"),
        f"rolling_std_{window}_15min": F.when(rows > 1, std),
    }
    if window in ZERO_WINDOWS:
        columns[f"zeros_in_last_{window}"] = F.col("_zeros_all")
    return df.withColumns(columns).drop(*[f"{name}_all" for name in _STATISTICS])


def _merge(df: DataFrame, size: int, count: int, keys: list[str]) -> DataFrame:
    """Statistics of ``size`` rows become those of ``size * count`` rows.

    Blocks merge by row count, mean and variance, which does not cancel as running
    totals would.
    """
    earlier = {
        f"{name}_{i}": F.lag(f"{name}_all", size * i).over(series_window(keys))
        for name in _STATISTICS
        for i in range(1, count)
    }
    df = df.withColumns(earlier)

    def block(name: str, i: int) -> Column:
        return F.col(f"{name}_{i}" if i else f"{name}_all")

    def total(part: Callable[[int], Column]) -> Column:
        return reduce(add, [F.coalesce(part(i), F.lit(0)) for i in range(count)])

    weighted = total(lambda i: block("_rows", i) * block("_mean", i))
    df = df.withColumn("_n", total(lambda i: block("_rows", i)))
    df = df.withColumn("_m", F.try_divide(weighted, F.col("_n")))

    def squares(i: int) -> Column:
        off = block("_mean", i) - F.col("_m")
        return block("_rows", i) * (block("_variance", i) + off * off)

    return df.withColumns(
        {
            "_variance_all": F.try_divide(total(squares), F.col("_n")),
            "_zeros_all": F.when(
                F.col("_zeros_all").isNotNull(), total(lambda i: block("_zeros", i))
            ),
            "_rows_all": F.col("_n"),
            "_mean_all": F.col("_m"),
        }
    ).drop(*earlier, "_n", "_m")


def with_spike(df: DataFrame) -> DataFrame:
    """Flag values far above the previous 96 rows. Reads the current ``y``."""
    flag = is_spike(F.col("y"), F.col("rolling_mean_96_15min"), F.col("rolling_std_96_15min"))
    return df.withColumn("is_spike", flag)


def with_same_interval_lags(
    df: DataFrame,
    days: int = SAME_INTERVAL_DAYS,
    rows_per_day: int = 1,
    keys: list[str] = KEYS,
) -> DataFrame:
    """Value of the same slot on earlier days.

    Inside one slot of the day a series has one row per day, so a day is one row;
    ``rows_per_day=96`` steps 96 days per lag instead.
    """
    w = Window.partitionBy(*keys, "interval_of_day").orderBy("ds")
    return df.withColumns(
        {
            f"same_interval_lag_{i}_day": F.lag("y", i * rows_per_day).over(w)
            for i in range(1, days + 1)
        }
    )


def with_split(
    df: DataFrame,
    train_share: float = TRAIN_SHARE,
    keys: list[str] = KEYS,
    whole_series: bool = True,
) -> DataFrame:
    """Add ``row``, ``rows`` and ``is_train``: the first ``int(rows * share)`` rows train.

    ``whole_series=False`` numbers the rows without a window over a whole series.
    """
    if whole_series:
        row = F.row_number().over(series_window(keys))
        rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        numbered = df.withColumns({"row": row, "rows": rows})
    else:
        numbered = number_rows(df, keys)
    return numbered.withColumn(
        "is_train", F.col("row") <= F.floor(F.col("rows") * F.lit(train_share))
    )


def with_enough_history(
    split: DataFrame, min_rows: int = 100, min_train: int = 50, min_test: int = 10
) -> DataFrame:
    """Rows of split series that are long enough on both sides."""
    train = F.floor(F.col("rows") * F.lit(TRAIN_SHARE))
    return split.filter(
        (F.col("rows") >= min_rows)
        & (train >= min_train)
        & (F.col("rows") - train >= min_test)
    )


def number_rows(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Add ``row``, the position in the series, and ``rows``, its length, without a
    window over the whole series.

    Rows are counted per day, the day counts are summed up along the series, and
    only the rows of one day are ever ordered together.
    """
    by_day = [*keys, "_date"]
    dated = df.withColumn("_date", F.to_date("ds"))
    earlier_days = (
        Window.partitionBy(*keys)
        .orderBy("_date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = dated.groupBy(*by_day).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *by_day,
        F.coalesce(F.sum("_n").over(earlier_days), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("rows"),
    )
    in_day = F.row_number().over(Window.partitionBy(*by_day).orderBy("ds"))
    return (
        dated.join(offsets, by_day)
        .withColumn("row", F.col("_before") + in_day)
        .drop("_date", "_before")
    )


def in_chunks(
    df: DataFrame,
    with_windows: Callable[[DataFrame, list[str]], DataFrame],
    chunk_rows: int,
    look_back: int = max(LAGS),
    keys: list[str] = KEYS,
) -> DataFrame:
    """Evaluate row windows over pieces of a series, exactly as over the whole series.

    A series is cut into pieces of ``chunk_rows`` rows. The last ``look_back`` rows
    of a piece are copied to the next one, so each row still sees all rows its
    frames reach; the copies are dropped afterwards. No task holds more than
    ``chunk_rows + look_back`` rows of a series. ``with_windows`` gets the frame and
    the partition keys to use and must not look back further than ``look_back`` rows.
    """
    if chunk_rows < look_back:
        raise ValueError("a chunk must be at least as long as the look-back")
    position = F.col("row") - 1
    chunk = F.floor(position / chunk_rows)
    feeds_next = position % chunk_rows >= chunk_rows - look_back
    targets = F.when(feeds_next, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    pieces = number_rows(df, keys).withColumn("_chunk", F.explode(targets))
    own = F.floor((F.col("row") - 1) / chunk_rows) == F.col("_chunk")
    return with_windows(pieces, [*keys, "_chunk"]).filter(own).drop("_chunk", "row", "rows")

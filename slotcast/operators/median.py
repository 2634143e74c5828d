"""Exact medians of whole columns, in one lazy plan for any number of rows.

Spark's exact ``median`` keeps all distinct values of a group in one task. Here the values
fall into cells between approximate quantiles, and only the values in the cells of the middle,
a few thousandths of a percent, are ranked.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that a column is cut into; a power of two.
CELLS = 4096


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact median of each column, ignoring NULLs.

    NaN counts as larger than any other value.
    """
    medians = medians_by_column(df, columns)
    return medians.agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns]
    )


def medians_by_column(df: DataFrame, columns: list[str], cells: int = CELLS) -> DataFrame:
    """Rows ``(column, median)``; none for a column without values.

    Cells are ordered as the values are and counted exactly, so the result is exact
    however far the quantiles between them are off.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    long = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    values = long.groupBy("column", "value").agg(F.count("value").alias("copies"))
    # The two middle ranks, counted from 0; equal when the number of rows is odd.
    rows = F.sum("copies")
    # One literal; a literal for each share would take longer to plan than the medians to run.
    shares = ",".join(str(i / cells) for i in range(1, cells))
    shares = F.split(F.lit(shares), ",").cast("array<double>")
    heads = values.groupBy("column").agg(
        F.floor((rows - 1) / 2).alias("low"),
        F.floor(rows / 2).alias("high"),
        F.percentile_approx("value", shares, 10_000).alias("ends"),
    )
    celled = values.join(heads, "column").select(
        "column", "value", "copies", "low", "high", _cell(cells).alias("cell")
    )
    sizes = celled.groupBy("column", "cell").agg(
        F.sum("copies").alias("rows"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    last = F.sum("rows").over(Window.partitionBy("column").orderBy("cell"))
    middle = (
        sizes.withColumn("last", last)
        .withColumn("before", F.col("last") - F.col("rows"))
        .filter((F.col("before") <= F.col("high")) & (F.col("last") > F.col("low")))
        .select("column", "cell", "before")
    )
    upto = F.col("before") + F.sum("copies").over(
        Window.partitionBy("column", "cell").orderBy("value")
    )
    hit = celled.join(middle, ["column", "cell"]).withColumn("upto", upto)
    found = [
        F.min(F.when(F.col("upto") > F.col(side), F.col("value"))).alias(side)
        for side in ("low", "high")
    ]
    return hit.groupBy("column").agg(*found).select(
        "column", _between(F.col("low"), F.col("high")).alias("median")
    )


def _between(low: Column, high: Column) -> Column:
    return F.when(low == high, low).otherwise(low / 2 + high / 2)


def _cell(cells: int) -> Column:
    """How many ends lie below the value, by binary search."""
    steps = [1 << i for i in reversed(range((cells - 1).bit_length()))]

    def halve(at: Column, step: Column) -> Column:
        end = F.try_element_at("ends", at + step)
        return at + F.when(F.col("value") > end, step).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)

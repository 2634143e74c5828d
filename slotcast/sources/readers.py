"""Sources. Every reader takes an explicit schema."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotcast import schemas
from slotcast.functions.calendar import moment
from slotcast.sources.storage import materialize, new_path


def _text(field: T.StructField) -> Column:
    return F.nullif(F.trim(F.col(f"`{field.name}`")), F.lit(""))


def _value(field: T.StructField) -> Column:
    """A text field as its type; NULL where it is blank or doesn't parse.

    Whole numbers may have a zero fraction, as other tools write columns with gaps. Timestamps
    may lack seconds, have a fraction, or a ``T`` between date and time.
    """
    if isinstance(field.dataType, T.StringType):
        return F.col(f"`{field.name}`")
    value = _text(field).try_cast(field.dataType)
    if isinstance(field.dataType, T.IntegralType):
        number = _text(field).try_cast("double")
        whole = F.when(number == F.floor(number), number.cast("long"))
        value = F.coalesce(value, whole.try_cast(field.dataType))
    return value


def _is_bad(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.lit(False)
    return _text(field).isNotNull() & _value(field).isNull()


def _parsed(field: T.StructField) -> Column:
    """A text field as its type. Blank is NULL; what doesn't parse fails the read."""
    message = F.concat(F.lit(f"{field.name} can't be read: "), _text(field))
    return F.when(_is_bad(field), F.raise_error(message)).otherwise(_value(field)).alias(field.name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(texts).option("header", True).option("mode", "FAILFAST").csv(path)
    return raw.select(*[_parsed(f).alias(f.name) for f in schema])


class TooManyRejects(ValueError):
    """A larger share of the rows can't be read than the caller allows."""


@dataclass(frozen=True)
class Load:
    """Rows that could be read, and the fields and lines that could not."""

    rows: DataFrame
    rejects: DataFrame
    n_rows: int
    n_rejected: int


#: Column that Spark puts a line into that doesn't have the expected fields.
_LINE = "_line"


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType, most_rejected: float = 0.0
) -> Load:
    """CSV rows, with those that don't parse set aside instead of ending the run.

    A row is rejected as a whole if a field has text that isn't of its type, or if it has more or
    fewer fields than the header. ``rejects`` has a row for each such field with the file it is
    in, its column, its text and the row's texts as JSON; a row of a wrong shape has no column.
    The files are read once: the texts are written to the shared folder with their verdict, and
    both counts are observed meanwhile. More than ``most_rejected`` of all rows raise
    ``TooManyRejects``, after which ``rejects`` can still be read from the path in its message.
    """
    names = [f.name for f in schema]
    texts = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(_LINE, T.StringType())])
    reader = spark.read.schema(texts).option("header", True).option("mode", "PERMISSIVE")
    raw = reader.option("columnNameOfCorruptRecord", _LINE).csv(path)
    faults = F.array(
        F.when(F.col(_LINE).isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col(_LINE).alias("text"))),
        *[
            F.when(
                F.col(_LINE).isNull() & _is_bad(f),
                F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("text")),
            )
            for f in schema
        ],
    )
    judged = raw.select(
        *names,
        F.filter(faults, lambda x: x.isNotNull()).alias("_faults"),
        F.col("_metadata.file_path").alias("_file"),
    )
    seen = Observation()
    counts = F.count(F.lit(1)).alias("all"), F.count_if(F.size("_faults") > 0).alias("bad")
    kept = materialize(judged.observe(seen, *counts), "csv-rows")
    n_rows, n_rejected = seen.get["all"], seen.get["bad"]
    rows = kept.filter(F.size("_faults") == 0).select(*[_value(f).alias(f.name) for f in schema])
    fault = F.explode("_faults").alias("x")
    line = F.to_json(F.struct(*names)).alias("line")
    rejects = kept.filter(F.size("_faults") > 0).select(F.col("_file").alias("file"), line, fault)
    rejects = rejects.select("file", "x.column", "x.text", "line")
    if n_rejected > most_rejected * n_rows:
        stored = new_path(spark, "csv-rejects")
        rejects.write.parquet(stored)
        raise TooManyRejects(f"{n_rejected} of {n_rows} rows of {path} can't be read, see {stored}")
    return Load(rows, rejects, n_rows, n_rejected)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SALES)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.WEATHER)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.HOLIDAY)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LOCATION_CSV)


def read_departments(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.DEPARTMENT)


def read_sales_types(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SALES_TYPE)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PREDICTION)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Baseline metrics document as rows ``(grain, mae)``."""
    document = spark.read.schema(schemas.METRICS).option("multiLine", True).json(path)
    return document.unpivot([], schemas.METRICS.fieldNames(), "grain", "mae")


def gzip_csv_to_parquet(
    spark: SparkSession, path: str, schema: T.StructType, target: str
) -> DataFrame:
    """Convert gzip CSV files to Parquet once.

    A gzip file cannot be split, so each one is a single read task; the rebalance
    spreads its rows over evenly sized output files for every later read.
    """
    read_csv(spark, path, schema).hint("rebalance").write.parquet(target)
    return spark.read.schema(schema).parquet(target)


def jdbc_options(
    url: str, table: str, partition_column: str, lower: str, upper: str, partitions: int
) -> dict[str, str]:
    """Options for a parallel relational scan, split on a date or numeric column."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": str(partitions),
        "pushDownPredicate": "true",
        "preferTimestampNTZ": "true",
    }


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def scan(table: DataFrame, columns: list[str], *predicates: Column) -> DataFrame:
    """Rows matching all predicates, only the named columns.

    Spark pushes both into a Parquet or JDBC scan.
    """
    for predicate in predicates:
        table = table.filter(predicate)
    return table.select(*columns)


def forecasts_between(
    forecast: DataFrame, start: dt.datetime, end: dt.datetime, location_id: int | None = None
) -> DataFrame:
    """Forecast rows with ``start <= ds <= end``, for one location or all."""
    predicates = [F.col("ds").between(moment(start), moment(end))]
    if location_id is not None:
        predicates.append(F.col("location_id") == location_id)
    return scan(forecast, schemas.FORECAST.fieldNames(), *predicates)

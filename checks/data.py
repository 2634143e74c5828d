"""Panel tables derived from the driver's test tables."""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.functions.calendar import moment, slot_start
from slotcast.operators.baseline import baseline_forecast
from slotcast.operators.clean import fill_department
from slotcast.operators.gapfill import dense_slots
from slotcast.operators.holidays import holiday_labels
from slotcast.operators.hierarchy import start_intervals
from slotcast.operators.windows import rolling_mean_columns
from slotcast.schemas import KEYS

FIRST_DAY = dt.date(2024, 1, 1)
LAST_DAY = dt.date(2024, 1, 30)

# Codes of the event types, which stand in for the sales types of a corporation.
EVENT_CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
WEATHER_CODES = {
    "click": "SC:VL:R",
    "error": "BR:H:RS",
    "purchase": "OV::OV",
    "signup": "NA:M:CL",
    "view": "DF:VH:FW",
}


def r(column: Column | str, digits: int = 6) -> Column:
    """Round for comparison; the small addend keeps values off the rounding boundary."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + 1e-9, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def _lookup(column: str, values: dict) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


class Data:
    """Fixture tables of one scale-factor folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path = f"{self.folder}/{name}.parquet"
            self._tables[name] = self.spark.read.parquet(path)
        return self._tables[name]

    @property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "ts",
            "value",
            "event_type",
            F.col("user_id"),
            (F.col("user_id") % 5).alias("location_id"),
            _lookup("event_type", EVENT_CODES).cast("long").alias("code"),
            slot_start(F.col("ts")).alias("ds"),
        )

    def _sales(self, department: Column) -> DataFrame:
        typed = self.events.withColumns(
            {
                "sales_type_id": 10 * F.col("location_id") + F.col("code"),
                "department_id": department.cast("long"),
            }
        )
        return typed.groupBy("ds", *KEYS).agg(F.round(F.sum("value"), 2).alias("y"))

    @property
    def sales(self) -> DataFrame:
        """15-minute sales without departments."""
        return self._sales(F.lit(None))

    @property
    def sales_by_department(self) -> DataFrame:
        """Sales with a department for the department-level types."""
        second = F.floor(F.col("user_id") / 5) % 2
        department = 100 * F.col("location_id") + 1 + second
        return self._sales(F.when(F.col("code").between(2, 4), department))

    @property
    def panel(self) -> DataFrame:
        return fill_department(self.sales)

    @property
    def dense(self) -> DataFrame:
        """The panel with every slot of the month, gaps as zero."""
        return dense_slots(self.panel, FIRST_DAY, LAST_DAY)

    @property
    def location(self) -> DataFrame:
        opens = F.col("c_nationkey") % 12
        hours = F.concat(
            F.lit('{"open": '), opens.cast("string"),
            F.lit(', "close": '), (opens + 12).cast("string"), F.lit("}"),
        )
        corporation = F.col("c_custkey") % 5
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            corporation.alias("corporation_id"),
            F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("postal_code"),
            (10 * corporation + 5).alias("default_sales_type_forecast"),
            hours.alias("hours"),
        )

    @property
    def sales_type(self) -> DataFrame:
        pairs = self.events.select("location_id", "code", "event_type").distinct()
        return pairs.select(
            (10 * F.col("location_id") + F.col("code")).alias("id"),
            F.col("location_id").alias("corporation_id"),
            F.col("event_type").alias("name"),
            F.when(F.col("code").isin(1, 5), F.lit("L")).otherwise(F.lit("D")).alias("level"),
            (F.col("code") != 2).alias("forecast_enabled"),
        )

    @property
    def department(self) -> DataFrame:
        corporation = F.col("p_partkey") % 5
        number = 1 + F.floor(F.col("p_partkey") / 5) % 2
        return (
            self.table("part")
            .groupBy(corporation.alias("corporation_id"), number.alias("number"))
            .agg(F.min("p_brand").alias("name"))
            .select(
                (100 * F.col("corporation_id") + F.col("number")).alias("id"),
                "corporation_id",
                "name",
                (F.col("number") == 1).alias("forecast_enabled"),
            )
        )

    @property
    def corporation(self) -> DataFrame:
        """The business day of corporation ``c`` starts ``c`` hours after midnight."""
        ids = self.table("customer").select((F.col("c_custkey") % 5).alias("id")).distinct()
        hours = F.make_dt_interval(F.lit(0), F.col("id").cast("int"))
        return ids.withColumn("start_time_interval", hours)

    @property
    def shifts(self) -> DataFrame:
        return start_intervals(self.location, self.corporation)

    @property
    def weather(self) -> DataFrame:
        """Irregular weather readings with codes."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(
            F.lpad((F.col("user_id") % 5).cast("string"), 8, "0").alias("postal_code"),
            F.col("ts").alias("ds"),
            (k - 45).cast("double").alias("real_feel"),
            (F.col("value") / 100).alias("precipitation"),
            F.when(k < 10, F.lit(1.0)).otherwise(F.lit(0.0)).alias("snow"),
            (k / 100).alias("coverage"),
            _lookup("event_type", WEATHER_CODES).alias("weather_code"),
        )

    @property
    def weather_daily(self) -> DataFrame:
        """Daily weather with two dates missing."""
        daily = self.weather.groupBy("postal_code", F.to_date("ds").alias("weather_date")).agg(
            F.avg("real_feel").alias("real_feel"),
            F.sum("precipitation").alias("precipitation"),
            F.sum("snow").alias("snow"),
            F.avg("coverage").alias("coverage"),
        )
        gone = [dt.date(2024, 1, 10), dt.date(2024, 1, 20)]
        return daily.filter(~F.col("weather_date").isin(gone))

    @property
    def holiday(self) -> DataFrame:
        """Busiest, quietest and first day of each corporation; two share a date."""
        daily = self.events.groupBy("location_id", F.to_date("ts").alias("d")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("code") == 5).alias("views")
        )
        days = daily.groupBy("location_id").agg(
            F.min(F.struct(-F.col("n"), "d"))["d"].alias("peak"),
            F.min(F.struct("n", "d"))["d"].alias("quiet"),
            F.min("d").alias("first"),
            F.min(F.struct(-F.col("views"), "d"))["d"].alias("viewpeak"),
        )
        entries = [
            ("peak", "peak", 1, 1),
            ("again", "peak", 0, 0),
            ("quiet", "quiet", -1, 0),
            ("first", "first", -2, 1),
            ("viewpeak", "viewpeak", 0, 2),
        ]
        rows = F.array(
            *[
                F.struct(
                    F.col(day).alias("ds"),
                    F.lit(name).alias("holiday"),
                    F.lit(lower).alias("lower_window"),
                    F.lit(upper).alias("upper_window"),
                )
                for name, day, lower, upper in entries
            ]
        )
        exploded = days.select(
            F.col("location_id").alias("corporation_id"), F.explode(rows).alias("h")
        )
        return exploded.select("corporation_id", "h.*")

    @property
    def postal_zone(self) -> DataFrame:
        zone = F.concat(F.lit("Z"), (F.col("c_custkey") % 7).cast("string"))
        postal = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
        return self.table("customer").select(postal.alias("postal_code"), zone.alias("zone"))

    @property
    def zone_scales(self) -> DataFrame:
        scales = F.concat(
            F.lit('{"real_feel":'), ((F.col("r_regionkey") + 1) / 10).cast("string"),
            F.lit(',"snow":5.0}'),
        )
        zone = F.concat(F.lit("Z"), F.col("r_regionkey").cast("string"))
        return self.table("region").select(zone.alias("zone"), scales.alias("prior_scales"))

    @property
    def labels(self) -> DataFrame:
        return holiday_labels(self.holiday, self.location)

    @property
    def pairs(self) -> DataFrame:
        """Held-out end of the dense panel with two predictions."""
        dense = self.dense
        base = baseline_forecast(dense, self.labels)
        mean = F.round(rolling_mean_columns([4])["rolling_mean_4_15min"] + 1e-9, 6)
        second = dense.select("ds", *KEYS, mean.alias("yhat_b"))
        return rounded(base, "yhat").join(second, ["ds", *KEYS])

    @property
    def forecast(self) -> DataFrame:
        """Stored sparse forecasts, here the sales themselves."""
        return self.sales_by_department.withColumnRenamed("y", "yhat")

    @property
    def batch(self) -> DataFrame:
        """Re-delivered days with doubled values."""
        days = F.col("ds").between(moment(dt.date(2024, 1, 10)), moment(dt.date(2024, 1, 12)))
        return self.sales_by_department.filter(days).withColumn("y", F.col("y") * 2)

    @property
    def long_daily(self) -> DataFrame:
        """Daily series over several years."""
        return (
            self.table("lineitem")
            .groupBy(
                F.ascii("l_returnflag").cast("long").alias("location_id"),
                F.ascii("l_linestatus").cast("long").alias("sales_type_id"),
                F.lit(0).cast("long").alias("department_id"),
                F.col("l_shipdate").alias("ds"),
            )
            .agg(F.sum("l_quantity").alias("y"))
        )


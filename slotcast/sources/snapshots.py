"""Tables stored by date, whose readers see one whole version of them.

A table is a folder with ``files/batch=<name>/date=<day>/`` and ``snapshots/<number>.json``. A
snapshot lists for each date the batch that holds it, a line per date. A commit writes the files
of the touched dates beside the old ones and then publishes the next snapshot by one rename. A
run that stops before leaves the table as it was; its files are listed nowhere.
"""

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConcurrentCommit(RuntimeError):
    """Another run has published a snapshot since this one read the table."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file context, through which every store that Spark reads can be reached."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target, jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, files = _files(spark, path)
    if not files.util().exists(folder):
        return []
    return [s.getPath().getName() for s in files.util().listStatus(folder)]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots of a table, oldest first; none for one never written."""
    names = _names(spark, f"{path}/snapshots")
    return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit())


def _listed(spark: SparkSession, path: str, version: int | None) -> dict[dt.date, str]:
    """The batch of every date. A table has thousands of dates at most."""
    if version is None:
        return {}
    lines = spark.read.schema("date date, batch string").json(f"{path}/snapshots/{version:09d}.json")
    return {row["date"]: row["batch"] for row in lines.collect()}


def _publish(spark: SparkSession, path: str, version: int, listed: dict[dt.date, str]) -> None:
    text = "".join(
        json.dumps({"date": day.isoformat(), "batch": batch}) + "\n"
        for day, batch in sorted(listed.items())
    )
    jvm = spark.sparkContext._jvm
    draft, files = _files(spark, f"{path}/snapshots/_{uuid.uuid4().hex}")
    final, _ = _files(spark, f"{path}/snapshots/{version:09d}.json")
    gateway = spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    parents = gateway.new_array(getattr(fs, "Options$CreateOpts"), 1)
    parents[0] = getattr(fs, "Options$CreateOpts").createParent()
    create = jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE)
    stream = files.create(draft, create, parents)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    # Without the option to overwrite, a rename onto another run's snapshot fails.
    none = gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        files.rename(draft, final, none)
    except Exception as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            raise ConcurrentCommit(f"snapshot {version} of {path} is there already") from error
        raise


def read_days(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    first: dt.date | None = None,
    last: dt.date | None = None,
    version: int | None = None,
) -> DataFrame:
    """Rows of the dates from ``first`` to ``last`` in a snapshot, the newest if none is named.

    Only the files of these dates are read, and a later commit doesn't change what is read. A table
    that was never written has no rows.
    """
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"{path} has no snapshot {version}")
    listed = _listed(spark, path, version or (known[-1] if known else None))
    wanted = [
        f"{path}/files/batch={batch}/date={day.isoformat()}"
        for day, batch in sorted(listed.items())
        if (first is None or day >= first) and (last is None or day <= last)
    ]
    if not wanted:
        return spark.createDataFrame([], schema)
    stored = T.StructType(
        [*schema.fields, T.StructField("batch", T.StringType()), T.StructField("date", T.DateType())]
    )
    rows = spark.read.schema(stored).option("basePath", f"{path}/files").parquet(*wanted)
    return rows.drop("batch", "date")


def commit_days(
    path: str,
    days: DataFrame,
    first: dt.date | None = None,
    last: dt.date | None = None,
    base: int | None = None,
) -> int:
    """Replace the dates from ``first`` to ``last`` by ``days``, which have a column ``ds``.

    Without a range, the dates of ``days`` are replaced. Dates of the range without rows become
    empty. ``base`` is the snapshot that ``days`` were derived from, 0 for none: if another has been
    published since, ``ConcurrentCommit`` is raised and the table stays as it is. ``days`` may read
    the same table. Returns the number of the new snapshot.
    """
    spark = days.sparkSession
    known = versions(spark, path)
    before = known[-1] if known else 0
    if base is not None and base != before:
        raise ConcurrentCommit(f"{path} is at snapshot {before}, not {base}")
    listed = _listed(spark, path, before or None)
    batch = uuid.uuid4().hex
    folder = f"{path}/files/batch={batch}"
    dated = days.withColumn("date", F.to_date("ds"))
    if first is not None:
        dated = dated.filter(F.col("date").between(F.lit(first), F.lit(last)))
    ordered = dated.hint("rebalance", "date").sortWithinPartitions("date", "location_id")
    ordered.write.partitionBy("date").parquet(folder)
    names = [n.removeprefix("date=") for n in _names(spark, folder) if n.startswith("date=")]
    if any(n.startswith("__") for n in names):
        raise ValueError("rows without a time can't be stored by date")
    written = [dt.date.fromisoformat(n) for n in names]
    kept = {
        day: own for day, own in listed.items() if first is None or not first <= day <= last
    }
    _publish(spark, path, before + 1, kept | dict.fromkeys(written, batch))
    return before + 1


def remove_unlisted(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` snapshots, and the batches that none of these lists.

    Not to be run beside a commit, whose batch is not listed yet. Returns the batches deleted.
    """
    known = versions(spark, path)
    for version in known[:-keep]:
        target, files = _files(spark, f"{path}/snapshots/{version:09d}.json")
        files.delete(target, False)
    listed = {b for version in known[-keep:] for b in _listed(spark, path, version).values()}
    there = [n for n in _names(spark, f"{path}/files") if n.startswith("batch=")]
    gone = sorted(n for n in there if n.removeprefix("batch=") not in listed)
    for name in gone:
        target, files = _files(spark, f"{path}/files/{name}")
        files.delete(target, True)
    return gone

"""The shared folder that survives the loss of an executor."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one machine, gets a
    temporary folder of its own when the setting is absent.
    """
    folder = spark.conf.get(_CHECKPOINT_DIR, None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder all executors can reach")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="slotcast-")
        folder = _local_folders[context.applicationId]
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: whatever reads the result later neither recomputes the
    upstream plan nor depends on blocks held by one executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

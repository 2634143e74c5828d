"""A training corpus in stages, each of which calls one operator of ``slotcast.llm``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.llm import jaccard, packing, quality, toxicity
from slotcast.sources.storage import materialize

#: Whole texts go to Python in Arrow batches of at most this size, or of one longer text. Ten
#: thousand rows would be some 30 MB, which stand several times in each task's direct memory.
BATCH_BYTES = "4m"
#: Rows that a Parquet reader decodes at a time. Arrays for 4,096 whole texts take many megabytes
#: each, which the heap has to place as a whole, and it grows for them.
READ_ROWS = "512"


def _bound_batches(spark: SparkSession) -> None:
    """For the session, as what a stage returns runs after the stage's function has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't find toxic."""
    _bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    part = toxicity.fold(F.col("doc_id"))
    return toxicity.clean(docs, toxicity.fit(docs, labels, part.isin(1, 2, 3), part == 4))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the quality limits of their language and source."""
    _bound_batches(spark)
    return quality.clean(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts link if four fifths of their shingles of five words are the same.
    """
    _bound_batches(spark)
    return jaccard.first_of_each(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, as pieces of sequences of 1024 tokens."""
    _bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard_join", drop_copies),
    ("best_fit_packing", pack),
]

#: Models and tokenizers can't be told in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

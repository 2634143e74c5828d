"""Boosted-tree regression, pooled over all series.

One MLlib model learns all series at once, with the series ids as features: Spark
trains one tree at a time over the whole distributed panel, so a pooled model
scales with the cluster where one small model per series would not.
"""

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.operators.windows import with_split
from slotcast.schemas import KEYS


@dataclass(frozen=True)
class TreeParams:
    """Boosting parameters; rounds and depth are kept small for a pooled model."""

    max_iter: int = 20
    max_depth: int = 5
    step_size: float = 0.1
    subsampling_rate: float = 0.8
    feature_subset: str = "0.85"
    min_instances: int = 15
    tolerance: float = 0.01
    seed: int = 42


# Sampling shares, smallest leaf and seed of the two parameter sets.
EVALUATION_PARAMS = TreeParams()
PRODUCTION_PARAMS = TreeParams(
    max_depth=4, subsampling_rate=0.7, feature_subset="0.8", min_instances=20
)
MIN_ROWS = 1000


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    numeric = rows.withColumns({f"_f_{c}": F.col(c).cast("double") for c in [*KEYS, *features]})
    inputs = [f"_f_{c}" for c in [*KEYS, *features]]
    assembler = VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="error")
    return assembler.transform(numeric).drop(*inputs)


def fit_trees(
    train: DataFrame, features: list[str], params: TreeParams = EVALUATION_PARAMS
) -> GBTRegressionModel:
    """Fit on rows with ``is_validation``; rounds stop once validation stops improving.

    Validation rows belong to the training share, so the scored rows stay unseen.
    """
    regressor = GBTRegressor(
        featuresCol="_features",
        labelCol="y",
        predictionCol="yhat_b",
        lossType="squared",
        maxIter=params.max_iter,
        maxDepth=params.max_depth,
        stepSize=params.step_size,
        subsamplingRate=params.subsampling_rate,
        featureSubsetStrategy=params.feature_subset,
        minInstancesPerNode=params.min_instances,
        validationIndicatorCol="is_validation",
        validationTol=params.tolerance,
        seed=params.seed,
    )
    data = _assembled(train, features).select("_features", "y", "is_validation")
    return regressor.fit(data)


def with_validation(train: DataFrame, share: float = 0.8) -> DataFrame:
    """Mark the last part of each series' training rows as validation."""
    split = with_split(train.drop("row", "rows", "is_train"), share)
    return split.withColumn("is_validation", ~F.col("is_train")).drop("row", "rows")


def predict_trees(model: GBTRegressionModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Add ``yhat_b``; evaluated inside the JVM."""
    return model.transform(_assembled(rows, features)).drop("_features")

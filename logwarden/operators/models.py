"""Supervised block classifiers on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SEED = 42


def with_balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes * n_class), so both classes count alike. The class table has two rows."""
    classes = train.groupBy(label).agg(F.count("*").alias("__n"))
    totals = classes.agg((F.sum("__n") / F.count("*")).alias("__share"))
    weights = classes.select(F.col(label).alias("__l"), (totals.scalar() / F.col("__n")).alias("weight"))
    return train.join(weights, F.col(label) == F.col("__l")).drop("__l")


def fit_logistic(train: DataFrame, label: str = "label", max_iter: int = 2000):
    """Class-balanced logistic regression with an L2 penalty of 1 on the summed loss.

    Spark divides the loss by the sum of weights, so the penalty is divided by it too; balanced
    weights sum to the row count.
    """
    weighted = cut_lineage(with_balanced_weights(train, label))
    rows = weighted.count()
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter,
        regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False,
    ).fit(weighted)


def fit_tree(train: DataFrame, label: str = "label", max_depth: int = 30, max_bins: int = 1024):
    """A decision tree grown until leaves are pure; 30 levels are the most that Spark builds.

    ``max_bins`` bounds the thresholds tried per feature; counts with fewer distinct values are all tried.
    """
    return DecisionTreeClassifier(
        featuresCol="features", labelCol=label, seed=SEED, maxDepth=max_depth, maxBins=max_bins
    ).fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    """Add ``score`` (probability of class 1) and integer ``predicted``."""
    out = model.transform(df)
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).withColumn(
        "predicted", F.col("prediction").cast("int")
    ).drop("rawPrediction", "probability", "prediction")

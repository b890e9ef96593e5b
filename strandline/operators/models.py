"""Models on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import metrics
from strandline.shared import stored

#: Parts of held rows for each core: tasks of a fit are even, and so many that no core waits long.
PARTS = 2

CLASSIFIERS = {
    "logit": lambda y, n: LogisticRegression(labelCol=y, featuresCol="_scaled", regParam=0.0, maxIter=50),
    "forest": lambda y, n: RandomForestClassifier(labelCol=y, featuresCol="_scaled", numTrees=20, maxDepth=5, seed=1),
    "boosted": lambda y, n: GBTClassifier(labelCol=y, featuresCol="_scaled", maxIter=10, maxDepth=4, seed=1),
    "mlp": lambda y, n: MultilayerPerceptronClassifier(labelCol=y, featuresCol="_scaled", layers=[n, 16, 8, 2], maxIter=50, seed=1),
}


def held(df: DataFrame, key: str) -> DataFrame:
    """The same rows, written once in even parts by a hash of their key and in its order: a fit reads its rows many times and goes as fast as its largest part."""
    return stored(df.repartition(PARTS * df.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key))


def classify(df: DataFrame, kind: str, features: Sequence[str], label: str, train: Column, keep: Sequence[str], **sizes) -> DataFrame:
    """Fit on the training rows that have a label, and return `keep`, the label and the probability of 1 for all rows.

    sizes: parameters of the estimator, such as numTrees=100, maxDepth=30 or layers=[n, 256, 128, 64, 2], in place of those of CLASSIFIERS.
    """
    if kind not in CLASSIFIERS:
        raise ValueError(f"unknown model {kind!r}")
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), CLASSIFIERS[kind](label, len(features)).setParams(**sizes)]
    rows = df.select(*keep, *(c for c in (*features, label) if c not in keep), train.alias("_train"))
    model = Pipeline(stages=stages).fit(rows.filter(F.col("_train") & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")))
    scored = model.transform(rows.withColumn(label, F.col(label).cast("double")))
    return scored.select(*keep, F.col(label).cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))


def univariate(df: DataFrame, outcomes: Sequence[str], predictors: Sequence[str], train: Column, key: str) -> DataFrame:
    """outcome, predictor, part (train or test), auroc, auprc of a logistic model of each outcome on each predictor alone.

    Rows without the outcome or the predictor are left out of both.  There is one fit for
    each pair, over all rows, which are read once and held; their number is that of the names given.
    """
    named = {f"_y{i}": F.col(y).cast("int") for i, y in enumerate(outcomes)} | {f"_x{i}": F.col(x).cast("double") for i, x in enumerate(predictors)}
    rows = held(df.select(F.col(key).alias("_key"), train.alias("_part"), *(c.alias(name) for name, c in named.items())), "_key")
    scores = []
    for i, y in enumerate(outcomes):
        for j, x in enumerate(predictors):
            pair = rows.select("_part", F.col(f"_x{j}").alias("x"), F.col(f"_y{i}").alias("y")).dropna(subset=["x", "y"])
            scored = classify(pair, "logit", ["x"], "y", F.col("_part"), ["_part"])
            scores.append(scored.select(F.lit(y).alias("outcome"), F.lit(x).alias("predictor"), F.when(F.col("_part"), "train").otherwise("test").alias("part"), "y", "score"))
    # Written once, and all pairs measured at once, instead of one scoring in each pass over each pair.
    return metrics.area(stored(reduce(DataFrame.unionByName, scores)), ["outcome", "predictor", "part"])

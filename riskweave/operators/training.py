"""Training, calibration and feature importance with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import sigmoid
from riskweave.operators import isotonic


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight n / (2 * n of the class) for a 0/1 label, so both classes weigh the same.

    The counts are one row, so the rows themselves are not shuffled.
    """
    yes = F.count_if(F.col(label) == 1)
    counts = df.agg(F.struct(F.count(label).alias("n"), yes.alias("pos")).alias("c"))
    n, pos = F.col("_c.n"), F.col("_c.pos")
    size = F.when(F.col(label) == 1, pos).otherwise(n - pos)
    return (
        df.withColumn("_c", counts.scalar())
        .withColumn(name, F.try_divide(n, 2.0 * size))
        .drop("_c")
    )


def stratified_folds(df: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """Fold number by hash of the key within the label; repeatable on any partitioning.

    A hash keeps the shares of each class equal up to chance without ordering the rows.
    """
    return df.withColumn(
        "fold", F.pmod(F.xxhash64(F.col(key), F.col(label)), F.lit(folds)).cast("int")
    )


def features(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    indexed = [f"{c}_index" for c in categorical]
    coded = [f"{c}_code" for c in categorical]
    stages = []
    if categorical:
        stages.append(
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep")
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded))
    stages.append(
        VectorAssembler(inputCols=[*numeric, *coded], outputCol="features", handleInvalid="keep")
    )
    return stages


def one_hot_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return Pipeline(stages=features([], columns)).fit(df).transform(df)


def cross_validated_trees(
    df: DataFrame,
    label: str,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    depths: Sequence[int] = (2, 3),
    folds: int = 3,
    rounds: int = 5,
    seed: int = 42,
):
    """Boosted trees with class weights; the depth is chosen by AUC over the folds."""
    prepared = stratified_folds(class_weights(df, label), label, key, folds)
    trees = GBTClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", maxIter=rounds, seed=seed
    )
    grid = ParamGridBuilder().addGrid(trees.maxDepth, list(depths)).build()
    chooser = CrossValidator(
        estimator=Pipeline(stages=[*features(numeric, categorical), trees]),
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol=label),
        numFolds=folds,
        foldCol="fold",
        seed=seed,
    )
    return chooser.fit(prepared)


def probabilities(model, df: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1])


def calibrated(
    train: DataFrame, apply: DataFrame, label: str, score: str, method: str = "isotonic"
) -> DataFrame:
    """Add ``calibrated`` to ``apply``; the map is learnt on ``train``."""
    if method == "isotonic":
        return isotonic.applied(isotonic.fitted(train, label, score), apply, score)
    if method == "sigmoid":
        stages = [
            VectorAssembler(inputCols=[score], outputCol="_score"),
            LogisticRegression(labelCol=label, featuresCol="_score"),
        ]
        fitted = Pipeline(stages=stages).fit(train).stages[-1]
        # Two numbers describe the map, so it is applied as a plain column.
        z = F.col(score) * float(fitted.coefficients[0]) + float(fitted.intercept)
        return apply.withColumn("calibrated", sigmoid(z))
    raise ValueError(f"method must be 'isotonic' or 'sigmoid', not {method!r}")


def tree_importance(
    df: DataFrame, label: str, numeric: Sequence[str], trees: int = 20, seed: int = 42
) -> DataFrame:
    """Random-forest importance and rank per numeric feature."""
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, seed=seed
    )
    model = Pipeline(stages=[*features(numeric, []), forest]).fit(df)
    values = model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(numeric, values), key=lambda r: (-r[1], r[0]))
    rows = [(name, float(v), i) for i, (name, v) in enumerate(ranked, 1)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, place int")

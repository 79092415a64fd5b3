"""Linear candidates on Spark ML, and scores from decision values."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import softmax, two_columns

from .dataset import class_weights
from .knn import standardiser


#: The most iterations of either model, and the tolerance that ends them sooner.
LOGISTIC_ITERATIONS, SVM_ITERATIONS, TOLERANCE = 3000, 5000, 1e-4


def prepared(fit: DataFrame, rows: DataFrame, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Both frames with features, standardised by the population statistics of the fit rows alone, and fit with its balanced weights."""
    standardise = standardiser(fit, vector)
    scaled = [standardise(df, "_z").withColumn("features", array_to_vector("_z")).drop("_z") for df in (fit, rows)]
    return scaled[0].join(class_weights(fit, label).select(label, "weight"), label), scaled[1]


def logistic(fit: DataFrame, rows: DataFrame, vector: str, label: str, max_iter: int = LOGISTIC_ITERATIONS) -> DataFrame:
    """rows with prediction and probability (array), by a multinomial regression with an L2 penalty of 1 / n."""
    fit, rows = prepared(fit, rows, vector, label)
    model = LogisticRegression(labelCol=label, weightCol="weight", family="multinomial", maxIter=max_iter, tol=1e-2 * TOLERANCE, regParam=1.0 / max(fit.count(), 1), elasticNetParam=0.0, standardization=False).fit(fit)
    return model.transform(rows).withColumn("probability", vector_to_array("probability"))


def linear_svm(fit: DataFrame, rows: DataFrame, vector: str, label: str, max_iter: int = SVM_ITERATIONS) -> DataFrame:
    """rows with prediction and probability: one linear machine for each class, hinge loss, softmax of their decision values."""
    fit, rows = prepared(fit, rows, vector, label)
    base = LinearSVC(maxIter=max_iter, tol=TOLERANCE, regParam=1.0 / max(fit.count(), 1), standardization=False)
    if fit.agg(F.max(label)).first()[0] == 1:
        # Two classes: one machine, its decision value as a pair of scores.
        found = base.setLabelCol(label).setWeightCol("weight").fit(fit).transform(rows)
        scores = two_columns(F.get(vector_to_array("rawPrediction"), 1))
    else:
        found = OneVsRest(classifier=base, labelCol=label, weightCol="weight", parallelism=4).fit(fit).transform(rows)
        scores = vector_to_array("rawPrediction")
    return found.withColumn("probability", softmax(scores))

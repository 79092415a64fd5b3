"""Accuracy, confusion matrix and report of predictions (true_index, predicted_index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import HIGH_FIRST, ranked


def accuracy() -> Column:
    return F.avg((F.col("true_index") == F.col("predicted_index")).cast("double"))


def top_k_accuracy(scores: DataFrame, k: int = 3, ties: str = HIGH_FIRST) -> DataFrame:
    """(top_k_accuracy): share of queries whose true class is among the first k; null for fewer classes than k."""
    own = ranked(scores, ties).where("class_index = true_index")
    n = scores.agg(F.countDistinct("class_index").alias("n"))
    return own.agg(F.avg((F.col("rank") <= k).cast("double")).alias("a")).crossJoin(n).select(F.when(F.col("n") >= k, F.col("a")).alias("top_k_accuracy"))


def confusion(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """(true_index, predicted_index, n) over the whole class domain."""
    domain = classes.select("class_index")
    grid = domain.withColumnRenamed("class_index", "true_index").crossJoin(domain.withColumnRenamed("class_index", "predicted_index"))
    counts = predictions.groupBy("true_index", "predicted_index").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["true_index", "predicted_index"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def confusion_wide(cells: DataFrame, indices: list[int], prefix: str = "c") -> DataFrame:
    """The matrix with a column for each class; rows are true classes."""
    return cells.groupBy("true_index").agg(*[F.sum(F.when(F.col("predicted_index") == i, F.col("n")).otherwise(0)).alias(f"{prefix}{i}") for i in indices])


def confusion_named(cells: DataFrame, class_names: list[str]) -> DataFrame:
    """The matrix as it is read: true_class, then a column for each class by name, rows and columns in the order of class_names."""
    names = F.array(*map(F.lit, class_names))
    rows = confusion_wide(cells, list(range(len(class_names))), "_c").orderBy("true_index")
    return rows.select(F.get(names, F.col("true_index").cast("int")).alias("true_class"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(class_names)])


def largest_cell(cells: DataFrame) -> DataFrame:
    """(largest): the maximum of the matrix."""
    return cells.agg(F.max("n").alias("largest"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def report(cells: DataFrame) -> DataFrame:
    """(class_index, precision, recall, f1, support) from the cells of a confusion matrix; undefined ratios are 0."""
    true = cells.groupBy(F.col("true_index").alias("class_index")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_index") == F.col("predicted_index"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("predicted_index").alias("class_index")).agg(F.sum("n").alias("said"))
    rows = true.join(said, "class_index").withColumns({"precision": _ratio(F.col("hit"), F.col("said")), "recall": _ratio(F.col("hit"), F.col("support"))})
    return rows.select("class_index", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), F.col("support").cast("double").alias("support"))


def averages(rows: DataFrame) -> DataFrame:
    """(average, precision, recall, f1, support): the macro and the weighted means of a report."""
    macro = rows.agg(F.lit("macro avg").alias("average"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("average"), *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return macro.unionByName(weighted)


def best(candidates: DataFrame) -> DataFrame:
    """The candidate with the highest validation_accuracy; equal ones by name."""
    return candidates.orderBy(F.desc("validation_accuracy"), "model_name").limit(1)

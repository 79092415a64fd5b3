"""Class ranks and wide predictions; the rule for equal scores is always stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_FIRST, HIGH_FIRST = "low", "high"
#: What a record says of an example.
RECORD = ["split", "class_name", "file_name", "image_path"]


def ranked(scores: DataFrame, ties: str) -> DataFrame:
    """scores with rank: by p descending, equal p by class index ascending (low) or descending (high)."""
    index = F.col("class_index").asc() if ties == LOW_FIRST else F.col("class_index").desc()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("p"), index)))


def wide(scores: DataFrame, ties: str, top: int = 3, predict_ties: str = LOW_FIRST) -> DataFrame:
    """One row per query: the first classes and their scores, the prediction, and whether it is right.

    Ranks beyond the number of classes are null.
    """
    rows = ranked(scores, ties).withColumnRenamed("rank", "_shown")
    rows = ranked(rows, predict_ties)
    pick = lambda column, at, by: F.max(F.when(F.col(by) == at, F.col(column)))
    columns = [F.max("true_index").alias("true_index"), pick("class_index", 1, "rank").alias("predicted_index"), pick("class_name", 1, "rank").alias("predicted_class"), F.max("p").alias("confidence")]
    columns += [pick("class_name", i, "_shown").alias(f"top_{i}_class") for i in range(1, top + 1)]
    columns += [pick("p", i, "_shown").alias(f"top_{i}_probability") for i in range(1, top + 1)]
    return rows.groupBy("qid").agg(*columns).withColumn("is_correct", F.col("true_index") == F.col("predicted_index"))


def with_confidences(predictions: DataFrame, scores: DataFrame, class_names: list[str]) -> DataFrame:
    """predictions with one column confidence__<class> for each class, in the order given."""
    columns = [F.max(F.when(F.col("class_name") == c, F.col("p"))).alias(f"confidence__{c}") for c in class_names]
    return predictions.join(scores.groupBy("qid").agg(*columns), "qid")


def long_confidences(predictions: DataFrame, key: str = "qid") -> DataFrame:
    """(key, class_name, confidence): the wide confidence columns unpivoted."""
    columns = [c for c in predictions.columns if c.startswith("confidence__")]
    found = predictions.unpivot([key], columns, "class_name", "confidence")
    return found.withColumn("class_name", F.substring_index("class_name", "confidence__", -1))


def with_records(predictions: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """predictions, one for each of rows, with the record columns that rows have, before them; the key under its own name."""
    kept = [c for c in RECORD if c in rows.columns and c != key]
    records = rows.select(F.col(key).alias("_key"), *kept)
    found = predictions.join(records, F.col("qid") == F.col("_key"))
    return found.select(F.col("_key").alias(key), *kept, *[c for c in predictions.columns if c != "qid"])


def shown(predictions: DataFrame) -> DataFrame:
    """The columns of a prediction table that are meant for reading: no path, no first class, which is the predicted one."""
    names = ["file_name", "true_class", "predicted_class", "is_correct", "top_1_confidence", "top_2_class", "top_2_confidence", "top_3_class", "top_3_confidence"]
    return predictions.select(*[c for c in names if c in predictions.columns], *[c for c in predictions.columns if c.startswith("confidence__")])


def preview(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first n rows by order; only these reach one task."""
    return rows.orderBy(order).limit(n)


def one_prediction(predictions: DataFrame, row_number: int, order: str) -> DataFrame:
    """(class_name, confidence, label): the confidences of the row at a place, from 0, of all rows by order; the highest first, equal ones by class."""
    row = predictions.orderBy(order).offset(row_number).limit(1)
    found = long_confidences(row, order).select("class_name", "confidence", F.format_number("confidence", 2).alias("label"))
    return found.orderBy(F.desc("confidence"), "class_name")

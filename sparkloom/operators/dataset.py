"""Operators on record tables: summaries, classes, checks and exact stratified splits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUFFIXES = ["jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff"]


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image(path: Column | str) -> Column:
    return suffix(path).isin(SUFFIXES)


def summary(*frames: DataFrame) -> DataFrame:
    """(split, class_name, image_count) over all frames."""
    rows = reduce(DataFrame.unionByName, [f.select("split", "class_name") for f in frames])
    return rows.groupBy("split", "class_name").agg(F.count(F.lit(1)).alias("image_count")).orderBy("split", "class_name")


def classes(records: DataFrame) -> DataFrame:
    """(class_index, class_name): the distinct classes in order; as many rows as classes."""
    names = records.select("class_name").distinct()
    return names.select((F.row_number().over(Window.orderBy("class_name")) - 1).alias("class_index"), "class_name")


def class_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("class_name").agg(F.count(F.lit(1)).alias("image_count"))


def count_stats(records: DataFrame) -> DataFrame:
    """(n_rows, n_classes, least): one row."""
    return class_counts(records).agg(F.coalesce(F.sum("image_count"), F.lit(0).cast("long")).alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), F.min("image_count").alias("least"))


def classes_not_in(records: DataFrame, others: DataFrame) -> DataFrame:
    return records.select("class_name").distinct().join(others.select("class_name").distinct(), "class_name", "left_anti").orderBy("class_name")


def check(dev: DataFrame, test: DataFrame) -> list[str]:
    """The guards of the workshop variant, in order: raises, or returns notes."""
    stats = count_stats(dev).first()
    if not stats["n_rows"]:
        raise ValueError("no labelled examples in the development split")
    if stats["n_classes"] < 2:
        raise ValueError("at least two classes are needed")
    notes = ["a class has fewer than two examples"] if stats["least"] < 2 else []
    if test.isEmpty():
        return notes
    if unknown := [r[0] for r in classes_not_in(test, dev).collect()]:
        raise ValueError("test classes without development examples: " + ", ".join(unknown))
    return notes + [f"class without test examples: {r[0]}" for r in classes_not_in(dev, test).collect()]


def holdout_size(n: int, n_classes: int, fraction: float) -> int:
    """Rows of a hold-out with room for every class."""
    return max(n_classes, math.ceil(fraction * n))


def check_holdout(dev: DataFrame, fraction: float) -> int:
    """The guards before a hold-out is cut from dev: raises, or returns its size."""
    stats = count_stats(dev).first()
    if stats["least"] is None or stats["least"] < 2:
        raise ValueError("without a test split every class needs at least two examples")
    if (size := holdout_size(stats["n_rows"], stats["n_classes"], fraction)) >= stats["n_rows"]:
        raise ValueError("too few examples for a hold-out; add more, or a test split")
    return size


def stratified_split(records: DataFrame, key: str, label: str, fraction: float = 0.2, at_least_classes: bool = False, salt: str = "42") -> DataFrame:
    """records with is_val: exactly ceil(fraction * n) rows, shared among classes by largest remainder.

    Within a class the rows whose salted md5 is least are held out, so the split does not depend on row order.  Keys are
    unique; rows without label are left out.  No class is sorted: rows are counted by label and beginning of the md5, and
    only those of the one beginning that a quota ends in, a 65536th of a class, are ranked.
    """
    counts = records.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy()
    goal = F.ceil(F.lit(fraction) * F.sum("_n").over(whole))
    if at_least_classes:
        goal = F.greatest(goal, F.count(F.lit(1)).over(whole))
    quotas = counts.withColumn("_goal", goal).withColumn("_share", F.col("_goal") * F.col("_n") / F.sum("_n").over(whole))
    quotas = quotas.withColumn("_floor", F.floor("_share"))
    quotas = quotas.withColumn("_left", F.col("_goal") - F.sum("_floor").over(whole))
    by_remainder = F.row_number().over(Window.orderBy(F.round(F.col("_share") - F.col("_floor"), 9).desc(), label))
    quotas = quotas.withColumn("_quota", F.col("_floor") + F.when(by_remainder <= F.col("_left"), 1).otherwise(0)).select(label, "_quota")
    digest = F.md5(F.concat_ws(":", F.lit(salt), F.col(key).cast("string")))
    part = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    sums = records.groupBy(label, part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    sums = sums.withColumn("_upto", F.sum("_rows").over(Window.partitionBy(label).orderBy("_part")))
    edge = sums.join(quotas, label).where("_upto >= _quota AND _upto - _rows < _quota").select(label, "_part", (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("_need"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_digest", key))
    last = records.select(label, key, digest.alias("_digest"), part.alias("_part")).join(edge, [label, "_part"])
    last = last.withColumn("_place", place).where("_place = _need").select(F.col(label).alias("_label"), F.struct("_digest", F.col(key).alias("_key")).alias("_last"))
    # One row for each class; a class without quota has none.
    found = records.where(F.col(label).isNotNull()).join(last, F.col(label) == F.col("_label"), "left")
    return found.withColumn("is_val", F.coalesce(F.struct(digest.alias("_digest"), F.col(key).alias("_key")) <= F.col("_last"), F.lit(False))).drop("_label", "_last")


def class_weights(records: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_total / (n_classes * n)."""
    counts = records.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n")))

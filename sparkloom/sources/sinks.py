"""Results as CSV and JSON files, on any file system that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def write_csv(df: DataFrame, path: str, index: bool = False) -> None:
    """One file with a header, which replaces what is there; for results as small as a report.

    index: the first column holds row names, so its header is blank.
    """
    spark, parts = df.sparkSession, f"{path}.parts"
    if index:
        df = df.withColumnRenamed(df.columns[0], "")
    df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(parts)
    store, folder = _file_system(spark, parts)
    _, target = _file_system(spark, path)
    found = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("part-")]
    store.delete(target, True)
    store.mkdirs(target.getParent())
    if found:
        store.rename(found[0], target)
    store.delete(folder, True)


def write_parts(df: DataFrame, folder: str) -> None:
    """CSV files with headers in a folder, one for each part of df."""
    df.write.mode("overwrite").option("header", True).csv(folder)


def metrics_json(metrics: DataFrame) -> str:
    """One row as indented JSON, nulls kept; a report becomes an object by class, with the accuracy before the averages."""
    told = metrics.first().asDict(recursive=True)
    if rows := told.get("classification_report"):
        name = lambda r: (r["label"] in ("macro avg", "weighted avg"), r["label"])
        by_class = {r["label"]: {"precision": r["precision"], "recall": r["recall"], "f1-score": r["f1"], "support": r["support"]} for r in sorted(rows, key=name)}
        averages = {k: by_class.pop(k) for k in ("macro avg", "weighted avg")}
        told["classification_report"] = by_class | {"accuracy": told["test_accuracy"]} | averages
    return json.dumps(told, indent=2, ensure_ascii=False)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON file in UTF-8."""
    store, target = _file_system(metrics.sparkSession, path)
    out = store.create(target, True)
    out.write(bytearray(metrics_json(metrics).encode()))
    out.close()

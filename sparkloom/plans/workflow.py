"""The two workflows from labelled feature rows to predictions, metrics and files.

Rows are (key, class_name, vectors) and, as far as they have them, the other columns of records, which predictions carry on.
Keys are whole numbers and unique.  The workflows differ in the candidates tried, the ties of class ranks and the metrics.
With a folder, feature rows, the selection and scores are written there once and read again by all that follows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import dataset, evaluation, knn, models, ranking
from sparkloom.sources import sinks


@dataclass(frozen=True)
class Result:
    selection: DataFrame | None
    predictions: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    #: The matrix with class names.
    matrix: DataFrame


def _indexed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "class_name", "left")  # a dimension as small as the classes are few


def knn_scores(fit: DataFrame, queries: DataFrame, classes: DataFrame, key: str, vector: str, ks: tuple[int, ...]) -> dict[int, DataFrame]:
    """Scores for each k from one neighbour search; statistics come from the fit rows."""
    standardise = knn.standardiser(fit, vector)
    near = knn.neighbours(standardise(queries), standardise(fit), key, "z", max(ks))
    near = near.join(fit.select(F.col(key).alias("tid"), "class_index"), "tid")
    truth = queries.select(F.col(key).alias("qid"), F.col("class_index").alias("true_index"))
    return {k: knn.scores(knn.vote(near, k), truth, classes) for k in ks}


def _of_model(found: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    long = found.select(F.col(key).alias("qid"), F.col("class_index").alias("true_index"), F.posexplode("probability").alias("class_index", "p"))
    return long.join(classes, "class_index")


#: Candidates: model and feature group.
CANDIDATES = [("linear_svm", "color"), ("logistic_regression", "all"), ("knn_cosine_k3", "all"), ("knn_cosine_k5", "all"), ("knn_cosine_k7", "all")]


def benchmark(dev: DataFrame, classes: DataFrame, key: str, vectors: dict[str, str], fraction: float = 0.2, linear: bool = True) -> DataFrame:
    """(model_name, feature_name, validation_accuracy, train_examples, validation_examples), best first."""
    split = dataset.stratified_split(_indexed(dev, classes), key, "class_name", fraction)
    fit, held = split.where("not is_val"), split.where("is_val")
    sizes = fit.count(), held.count()
    found = [(f"knn_cosine_k{k}", "all", s) for k, s in knn_scores(fit, held, classes, key, vectors["all"], (3, 5, 7)).items()]
    if linear:
        found.append(("logistic_regression", "all", _of_model(models.logistic(fit, held, vectors["all"], "class_index"), classes, key)))
        found.append(("linear_svm", "color", _of_model(models.linear_svm(fit, held, vectors["color"], "class_index"), classes, key)))
    rows = [
        ranking.wide(s, ranking.LOW_FIRST).agg(F.lit(n).alias("model_name"), F.lit(g).alias("feature_name"), evaluation.accuracy().alias("validation_accuracy")).withColumns({"train_examples": F.lit(sizes[0]).cast("long"), "validation_examples": F.lit(sizes[1]).cast("long")})
        for n, g, s in found
    ]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("validation_accuracy"), "model_name")


def _kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    if folder is None:
        return df.persist()
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _measured(scores: DataFrame, predictions: DataFrame, classes: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(test_accuracy, test_top_3_accuracy, test_examples), cells, and the report as one row of structs."""
    cells = evaluation.confusion(predictions, classes)
    rows = evaluation.report(cells).join(classes, "class_index").select(F.col("class_name").alias("label"), "precision", "recall", "f1", "support")
    rows = rows.unionByName(evaluation.averages(rows).withColumnRenamed("average", "label"))
    report = rows.agg(F.array_sort(F.collect_list(F.struct("label", "precision", "recall", "f1", "support"))).alias("classification_report"))
    one = predictions.agg(evaluation.accuracy().alias("test_accuracy"), F.count(F.lit(1)).alias("test_examples"))
    top = evaluation.top_k_accuracy(scores).withColumnRenamed("top_k_accuracy", "test_top_3_accuracy")
    return one.crossJoin(top), cells, report


def _names(classes: DataFrame) -> list[str]:
    return [r["class_name"] for r in classes.orderBy("class_index").collect()]


def _texts(values: list) -> Column:
    return F.array(*map(F.lit, values))


def scores_of(name: str, feature: str, fit: DataFrame, queries: DataFrame, classes: DataFrame, key: str, vectors: dict[str, str]) -> DataFrame:
    """The scores of a candidate, which must be one of those compared."""
    if (name, feature) not in CANDIDATES:
        raise ValueError(f"no such candidate: {name} on {feature}")
    if name.startswith("knn"):
        k = int(name.rsplit("k", 1)[1])
        return knn_scores(fit, queries, classes, key, vectors[feature], (k,))[k]
    model = {"logistic_regression": models.logistic, "linear_svm": models.linear_svm}[name]
    return _of_model(model(fit, queries, vectors[feature], "class_index"), classes, key)


def run_main(dev: DataFrame, test: DataFrame, key: str, vectors: dict[str, str], folder: str | None = None, prototype_name: str = "", image_size: tuple[int, int] = (96, 96)) -> Result:
    """Candidates compared on a stratified hold-out; the best is refitted on all of dev.  Equal scores rank the higher class first."""
    if dev.isEmpty() or test.isEmpty():
        raise FileNotFoundError("both splits need labelled examples")
    if folder is not None:
        dev, test = _kept(dev, folder, "features_dev"), _kept(test, folder, "features_test")
    classes = dataset.classes(dev)
    selection = _kept(benchmark(dev, classes, key, vectors), folder, "selection").orderBy(F.desc("validation_accuracy"), "model_name")
    top = evaluation.best(selection).first()
    fit, queries = _indexed(dev, classes), _indexed(test, classes).where("class_index is not null")
    scores = _kept(scores_of(top["model_name"], top["feature_name"], fit, queries, classes, key, vectors), folder, "scores")
    predicted = ranking.wide(scores, ranking.HIGH_FIRST)
    names = _names(classes)
    one, cells, report = _measured(scores, predicted, classes, names)
    one = one.crossJoin(report)
    metrics = one.select(
        F.lit(prototype_name).alias("prototype_name"), F.lit(top["model_name"]).alias("selected_model"), F.lit(top["feature_name"]).alias("selected_feature_set"), F.lit(top["validation_accuracy"]).alias("validation_accuracy"),
        "test_accuracy", "test_top_3_accuracy", F.lit(fit.count()).alias("train_examples"), "test_examples", _texts(names).alias("class_names"), _texts(list(image_size)).alias("image_size"), "classification_report",
    )
    return Result(selection, ranking.with_records(predicted, test, key), metrics, cells, evaluation.confusion_named(cells, names))


def run_workshop(dev: DataFrame, test: DataFrame, key: str, vector: str, folder: str | None = None, image_size: tuple[int, int] = (96, 96)) -> Result:
    """One k-nearest-neighbour model; a hold-out is cut from dev where there is no test split.  Equal scores rank the lower class first."""
    dataset.check(dev, test)
    if folder is not None:
        dev, test = _kept(dev, folder, "features_dev"), _kept(test, folder, "features_test")
    if test.isEmpty():
        dataset.check_holdout(dev, 0.25)
        split = dataset.stratified_split(dev, key, "class_name", 0.25, at_least_classes=True)
        dev, test = split.where("not is_val").drop("is_val"), split.where("is_val").drop("is_val")
    classes = dataset.classes(dev)
    fit, queries = _indexed(dev, classes), _indexed(test, classes)
    n = fit.count()
    k = min(5, n)
    scores = _kept(knn_scores(fit, queries, classes, key, vector, (k,))[k], folder, "scores")
    names = _names(classes)
    wide = ranking.wide(scores, ranking.LOW_FIRST)
    one, cells, _ = _measured(scores, wide, classes, names)
    found = ranking.with_records(ranking.with_confidences(wide, scores, names), test, key)
    tops = [f"top_{i}_class" for i in (1, 2, 3)], [F.col(f"top_{i}_probability").alias(f"top_{i}_confidence") for i in (1, 2, 3)]
    records = [c for c in ("file_name", "image_path") if c in found.columns]
    predictions = found.select(*([] if key in records else [key]), *records, F.col("class_name").alias("true_class"), "predicted_class", *tops[0], *tops[1], "is_correct", *[f"confidence__{c}" for c in names])
    metrics = one.select(
        F.lit("knn_cosine").alias("model"), F.lit(k).alias("n_neighbors"), F.lit("HSV + HOG + LBP").alias("feature_set"), _texts(list(image_size)).alias("image_size"),
        F.lit(n).alias("train_examples"), "test_examples", "test_accuracy", "test_top_3_accuracy", _texts(names).alias("classes"),
    )
    return Result(None, predictions, metrics, cells, evaluation.confusion_named(cells, names))


def accuracy_lines(metrics: DataFrame) -> DataFrame:
    """(line): what a reader is told of the accuracies."""
    percent = lambda c: F.format_string("%.2f%%", 100 * F.col(c))
    top = F.when(F.col("test_top_3_accuracy").isNull(), "Top-3 accuracy skipped: fewer than 3 classes").otherwise(F.concat(F.lit("Top-3 accuracy: "), percent("test_top_3_accuracy")))
    return metrics.select(F.explode(F.array(F.concat(F.lit("Accuracy: "), percent("test_accuracy")), top)).alias("line"))


def save(result: Result, folder: str, summary: DataFrame | None = None, prefix: str = "", whole: bool = True) -> None:
    """The files of a run; predictions go to one file or, if not whole, to a folder of parts, as there may be many."""
    name = lambda x: f"{folder.rstrip('/')}/{prefix}{x}"
    if result.selection is not None:
        sinks.write_csv(result.selection, name("model_selection.csv"))
    predictions = "predictions" if prefix else "test_predictions"
    sinks.write_csv(result.predictions, name(f"{predictions}.csv")) if whole else sinks.write_parts(result.predictions, name(predictions))
    sinks.write_csv(result.matrix, name("confusion_matrix.csv"), index=True)
    if summary is not None:
        sinks.write_csv(summary, name("dataset_summary.csv"))
    sinks.write_metrics(result.metrics, name("metrics.json"))

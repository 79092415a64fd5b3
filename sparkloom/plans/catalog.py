"""The registered queries of the classification engine; vec_id % 5 = 0 is the test split of embeddings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import vectors as V
from sparkloom.operators import dataset, evaluation, histogram, knn, models, ranking

from .sql import ORACLES
from .workflow import knn_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.when(F.col("vec_id") % 5 == 0, "dataset_test").otherwise("dataset_dev").alias("split"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_name"))


def _parts(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("class_index"))
    test = F.col("vec_id") % 5 == 0
    fit = rows.where(~test)
    classes = fit.select("class_index", F.concat(F.lit("c"), F.col("class_index").cast("string")).alias("class_name")).distinct()
    return fit, rows.where(test), classes


def _scores(spark, sf_dir, ks=(5,)):
    fit, queries, classes = _parts(spark, sf_dir)
    found = knn_scores(fit, queries, classes, "vec_id", "embedding", ks)
    return found, classes


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def dataset_summary(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return dataset.summary(rows.where("split = 'dataset_dev'"), rows.where("split = 'dataset_test'"))


def discover_classes(spark, sf_dir):
    return dataset.classes(_records(spark, sf_dir).where("split = 'dataset_dev'"))


def class_count_stats(spark, sf_dir):
    return dataset.count_stats(_records(spark, sf_dir))


def class_value_counts(spark, sf_dir):
    return dataset.class_counts(_records(spark, sf_dir)).orderBy("class_name")


def unknown_classes(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("class_name"))
    return dataset.classes_not_in(rows, rows.where("doc_id % 3 = 0"))


def missing_classes(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("class_name"))
    return dataset.classes_not_in(rows, rows.where("doc_id % 5 = 0"))


def suffix_filter(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", dataset.suffix("url").alias("suffix"), dataset.is_image("url").alias("is_image"))


def stratified_split(spark, sf_dir):
    return dataset.stratified_split(_table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label").select("vec_id", "label", "is_val")


def feature_stats(spark, sf_dir):
    return _rounded(knn.feature_stats(_parts(spark, sf_dir)[0], "embedding"), 6, "mean", "deviation")


def knn_neighbors(spark, sf_dir):
    fit, queries, _ = _parts(spark, sf_dir)
    return knn.neighbours(*map(knn.standardiser(fit, "embedding"), (queries, fit)), "vec_id", "z", 5)


def knn_vote(spark, sf_dir):
    found = ranking.ranked(_scores(spark, sf_dir)[0][5], ranking.LOW_FIRST)
    return _rounded(found.select("qid", "true_index", "class_index", "p", "rank"), 6, "p")


def _wide(spark, sf_dir, ties):
    return _rounded(ranking.wide(_scores(spark, sf_dir)[0][5], ties), 6, "confidence", *[f"top_{i}_probability" for i in (1, 2, 3)])


def top3_wide_low_tie(spark, sf_dir):
    return _wide(spark, sf_dir, ranking.LOW_FIRST)


def top3_wide_high_tie(spark, sf_dir):
    return _wide(spark, sf_dir, ranking.HIGH_FIRST)


def accuracy_topk(spark, sf_dir):
    scores = _scores(spark, sf_dir)[0][5]
    one = ranking.wide(scores, ranking.LOW_FIRST).agg(F.round(evaluation.accuracy(), 9).alias("accuracy"))
    return one.crossJoin(evaluation.top_k_accuracy(scores).select(F.round("top_k_accuracy", 9).alias("top_3_accuracy")))


def _cells(spark, sf_dir):
    found, classes = _scores(spark, sf_dir)
    return evaluation.confusion(ranking.wide(found[5], ranking.LOW_FIRST), classes)


def confusion_matrix(spark, sf_dir):
    return _cells(spark, sf_dir)


def confusion_wide(spark, sf_dir):
    return evaluation.confusion_wide(_cells(spark, sf_dir), list(range(10)))


def classification_report(spark, sf_dir):
    return _rounded(evaluation.report(_cells(spark, sf_dir)), 9, "precision", "recall", "f1")


def report_averages(spark, sf_dir):
    return _rounded(evaluation.averages(evaluation.report(_cells(spark, sf_dir))), 9, "precision", "recall", "f1")


def model_selection(spark, sf_dir):
    """k = 3, 5 and 7 from one neighbour search."""
    fit, _, _ = _parts(spark, sf_dir)
    n = fit.agg(F.count(F.lit(1)).alias("train_examples"))
    rows = [
        ranking.wide(s, ranking.LOW_FIRST).agg(F.lit(f"knn_cosine_k{k}").alias("model_name"), F.lit("all").alias("feature_name"), F.round(evaluation.accuracy(), 9).alias("validation_accuracy"), F.count(F.lit(1)).alias("validation_examples"))
        for k, s in _scores(spark, sf_dir, (3, 5, 7))[0].items()
    ]
    found = reduce(DataFrame.unionByName, rows).crossJoin(n)
    return found.select("model_name", "feature_name", "validation_accuracy", "train_examples", "validation_examples").orderBy(F.desc("validation_accuracy"), "model_name")


def best_model(spark, sf_dir):
    return evaluation.best(model_selection(spark, sf_dir))


def confidence_unpivot(spark, sf_dir):
    scores = _scores(spark, sf_dir)[0][5]
    names = [f"c{i}" for i in range(10)]
    wide = ranking.with_confidences(ranking.wide(scores, ranking.LOW_FIRST), scores, names)
    return _rounded(ranking.long_confidences(wide).where("confidence is not null"), 6, "confidence")


def _predictions(spark, sf_dir):
    scores = _scores(spark, sf_dir)[0][5]
    return ranking.with_confidences(ranking.wide(scores, ranking.LOW_FIRST), scores, [f"c{i}" for i in range(10)])


def first_predictions(spark, sf_dir):
    """head(5) of the predictions by key."""
    return _rounded(ranking.preview(_predictions(spark, sf_dir), "qid", 5).select("qid", "predicted_class", "confidence", "is_correct"), 6, "confidence")


def one_prediction(spark, sf_dir):
    """The confidences of the fourth prediction by key, highest first, with their labels."""
    return _rounded(ranking.one_prediction(_rounded(_predictions(spark, sf_dir), 6, *[f"confidence__c{i}" for i in range(10)]), 3, "qid"), 6, "confidence")


def confusion_named(spark, sf_dir):
    return evaluation.confusion_named(_cells(spark, sf_dir), [f"c{i}" for i in range(10)])


def largest_cell(spark, sf_dir):
    return evaluation.largest_cell(_cells(spark, sf_dir))


def preview_records(spark, sf_dir):
    """The first ten pages by address."""
    return ranking.preview(_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", 10)


def class_weights(spark, sf_dir):
    return _rounded(dataset.class_weights(_table(spark, sf_dir, "labels"), "quality"), 9, "weight")


def hist_1d(spark, sf_dir):
    return _rounded(histogram.histogram(_table(spark, sf_dir, "events"), [("value", 0, 100, 10)]), 9, "mass")


def hist_3d(spark, sf_dir):
    axes = [("l_quantity", 1, 50, 10), ("l_discount", 0, 0.1, 4), ("l_tax", 0, 0.08, 4)]
    return _rounded(histogram.histogram(_table(spark, sf_dir, "lineitem"), axes), 9, "mass")


def softmax_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", V.softmax(V.doubles("embedding")).alias("s"))
    return _rounded(rows.select("vec_id", F.posexplode("s").alias("class_index", "p")), 9, "p")


def l1_normalised(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", V.l1_normalise(F.transform(V.doubles("embedding"), F.abs)).alias("s"))
    return _rounded(rows.select("vec_id", F.posexplode("s").alias("pos", "mass")), 9, "mass")


def _linear(spark, sf_dir, model):
    fit, queries, _ = _parts(spark, sf_dir)
    found = model(fit, queries, "embedding", "class_index")
    return found.select("vec_id", F.col("class_index").alias("true_index"), F.col("prediction").cast("int").alias("predicted_index"), F.round(F.array_max("probability"), 6).alias("confidence"))


def logistic_regression(spark, sf_dir):
    return _linear(spark, sf_dir, models.logistic)


def linear_svm(spark, sf_dir):
    return _linear(spark, sf_dir, models.linear_svm)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [dataset_summary, discover_classes, class_count_stats, class_value_counts, unknown_classes, missing_classes, suffix_filter, stratified_split, feature_stats, knn_neighbors, knn_vote, top3_wide_low_tie, top3_wide_high_tie, accuracy_topk, confusion_matrix, confusion_wide, classification_report, report_averages, model_selection, best_model, confidence_unpivot, first_predictions, one_prediction, confusion_named, largest_cell, preview_records, class_weights, hist_1d, hist_3d, softmax_scores, l1_normalised, logistic_regression, linear_svm]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return ORACLES

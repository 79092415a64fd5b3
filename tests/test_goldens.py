"""Published aggregates as literals, guards and properties."""

import colorsys
import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import describe
from sparkloom.functions import vectors as V
from sparkloom.operators import dataset, evaluation, models, ranking
from sparkloom.plans import workflow
from sparkloom.sources import images

#: The published confusion matrix (rows true, columns predicted) and validation accuracies.
MATRIX = [[143, 21, 9, 8, 18], [5, 102, 9, 30, 19], [3, 15, 60, 8, 4], [3, 7, 4, 84, 4], [18, 23, 5, 19, 50]]
SELECTION = [("linear_svm", 184 / 277), ("knn_cosine_k7", 202 / 277), ("knn_cosine_k3", 201 / 277), ("knn_cosine_k5", 202 / 277), ("logistic_regression", 193 / 277)]


def test_report_of_published_matrix(spark):
    cells = spark.createDataFrame([(i, j, n) for i, r in enumerate(MATRIX) for j, n in enumerate(r)], "true_index int, predicted_index int, n long")
    rows = evaluation.report(cells)
    first = rows.where("class_index = 0").first()
    assert (first.precision, first.recall, first.f1, first.support) == pytest.approx((0.8313953488372093, 0.7185929648241206, 0.77088948787062, 199.0), abs=1e-12)
    means = {r.average: r for r in evaluation.averages(rows).collect()}
    assert means["macro avg"].f1 == pytest.approx(0.641396277506394, abs=1e-12)
    assert means["weighted avg"].recall == pytest.approx(0.65424739195231, abs=1e-12)


def test_best_by_name_among_equals(spark):
    random.shuffle(SELECTION)
    assert evaluation.best(spark.createDataFrame(SELECTION, "model_name string, validation_accuracy double")).first().model_name == "knn_cosine_k5"


def test_tie_rules(spark):
    p = {0: 0.8040589620218731, 6: 0.1959410379781269}
    names = ["apple", "banana", "cherry", "chickoo", "grapes", "kiwi", "mango", "orange", "strawberry"]
    p = {0: p[0], 7: p[6]}
    scores = spark.createDataFrame([(1, 0, i, n, p.get(i, 0.0)) for i, n in enumerate(names)], "qid long, true_index int, class_index int, class_name string, p double")
    tops = lambda ties: tuple(ranking.wide(scores, ties).select("top_1_class", "top_2_class", "top_3_class").first())
    assert tops(ranking.LOW_FIRST) == ("apple", "orange", "banana")
    assert tops(ranking.HIGH_FIRST) == ("apple", "orange", "strawberry")
    two = ranking.wide(scores.where("class_index < 2"), ranking.LOW_FIRST).first()
    assert two.top_3_class is None and two.top_3_probability is None


def test_largest_remainder_split(spark):
    sizes = {"01": 405, "02": 351, "03": 191, "04": 205, "05": 232}
    rows = spark.createDataFrame([(i, c) for c, n in sizes.items() for i in range(n)], "id long, class_name string")
    got = dataset.stratified_split(rows, "id", "class_name").where("is_val").groupBy("class_name").count().collect()
    assert {r.class_name: r["count"] for r in got} == {"01": 81, "02": 70, "03": 38, "04": 41, "05": 47}


def test_guards(spark):
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "class_name string")
    none = spark.createDataFrame([], "class_name string")
    for dev, test, said in ((none, none, "no labelled"), (rows("a", "a"), none, "two classes"), (rows("a", "b"), rows("c"), "test classes without")):
        with pytest.raises(ValueError, match=said):
            dataset.check(dev, test)
    assert dataset.check(rows("a", "b"), rows("a")) == ["a class has fewer than two examples", "class without test examples: b"]


def vectors(spark, n, classes=3, seed=1, split="dataset_dev"):
    rng = np.random.default_rng(seed)
    rows = [(seed * 1000 + i, split, f"c{i % classes}", f"Image_{i}.jpg", f"/x/{i}", (rng.standard_normal(6) + 3 * np.eye(6)[i % classes]).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, split string, class_name string, file_name string, image_path string, v array<double>")


def test_main_workflow(spark, tmp_path):
    dev, test = vectors(spark, 60), vectors(spark, 15, seed=2, split="dataset_test")
    main = workflow.run_main(dev, test, "id", {"all": "v", "color": "v"}, folder=f"{tmp_path}/work")
    assert main.selection.count() == 5
    m = main.metrics.first()
    assert m.test_examples == 15 and m.test_accuracy > 0.6 and len(m.classification_report) == 5
    workflow.save(main, f"{tmp_path}/out", dataset.summary(dev, test))
    lines = lambda name: (tmp_path / "out" / name).read_text().splitlines()
    assert len(lines("model_selection.csv")) == 6 and len(lines("dataset_summary.csv")) == 7
    assert lines("test_predictions.csv")[0] == "id,split,class_name,file_name,image_path,true_index,predicted_index,predicted_class,confidence,top_1_class,top_2_class,top_3_class,top_1_probability,top_2_probability,top_3_probability,is_correct"
    assert sorted(x.split(",")[:5] for x in lines("test_predictions.csv")[1:]) == sorted([str(2000 + i), "dataset_test", f"c{i % 3}", f"Image_{i}.jpg", f"/x/{i}"] for i in range(15))
    matrix = [x.split(",") for x in lines("confusion_matrix.csv")]
    assert matrix[0] == ["", "c0", "c1", "c2"] and [r[0] for r in matrix[1:]] == ["c0", "c1", "c2"] and sum(int(x) for r in matrix[1:] for x in r[1:]) == 15
    told = json.loads((tmp_path / "out" / "metrics.json").read_text())
    assert list(told) == ["prototype_name", "selected_model", "selected_feature_set", "validation_accuracy", "test_accuracy", "test_top_3_accuracy", "train_examples", "test_examples", "class_names", "image_size", "classification_report"]
    assert list(told["classification_report"]) == ["c0", "c1", "c2", "accuracy", "macro avg", "weighted avg"] and told["image_size"] == [96, 96]
    assert set(told["classification_report"]["c0"]) == {"precision", "recall", "f1-score", "support"}
    # Written once, so the rest can be read without what made it.
    assert spark.read.parquet(f"{tmp_path}/work/features_dev").count() == 60 and spark.read.parquet(f"{tmp_path}/work/scores").count() == 45
    with pytest.raises(FileNotFoundError):
        workflow.run_main(dev, test.limit(0), "id", {"all": "v", "color": "v"})
    with pytest.raises(ValueError, match="no such candidate"):
        workflow.scores_of("knn_cosine_k9", "all", dev, test, dev, "id", {"all": "v"})


def test_workshop(spark, tmp_path):
    dev = vectors(spark, 60)
    shop = workflow.run_workshop(dev, dev.limit(0), "id", "v")
    m = shop.metrics.first()
    assert (m.test_examples, m.train_examples, m.n_neighbors, m.model, list(m.classes)) == (15, 45, 5, "knn_cosine", ["c0", "c1", "c2"])
    assert shop.predictions.columns == ["id", "file_name", "image_path", "true_class", "predicted_class", "top_1_class", "top_2_class", "top_3_class", "top_1_confidence", "top_2_confidence", "top_3_confidence", "is_correct", "confidence__c0", "confidence__c1", "confidence__c2"]
    assert ranking.shown(shop.predictions).columns == ["file_name", "true_class", "predicted_class", "is_correct", "top_1_confidence", "top_2_class", "top_2_confidence", "top_3_class", "top_3_confidence", "confidence__c0", "confidence__c1", "confidence__c2"]
    one = ranking.one_prediction(shop.predictions, 2, "id").collect()
    assert len(one) == 3 and one[0].confidence == max(r.confidence for r in one) and one[0].label == f"{one[0].confidence:.2f}"
    workflow.save(shop, str(tmp_path), prefix="workshop_")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["workshop_confusion_matrix.csv", "workshop_metrics.json", "workshop_predictions.csv"]
    assert [r.line for r in workflow.accuracy_lines(spark.createDataFrame([(29 / 45, 37 / 45)], "test_accuracy double, test_top_3_accuracy double")).collect()] == ["Accuracy: 64.44%", "Top-3 accuracy: 82.22%"]
    few = vectors(spark, 4, classes=3)
    with pytest.raises(ValueError, match="at least two examples"):
        workflow.run_workshop(few, few.limit(0), "id", "v")
    few = vectors(spark, 4, classes=2).unionByName(vectors(spark, 4, classes=2, seed=3).replace({"c0": "c2", "c1": "c3"}, subset="class_name"))
    assert dataset.check_holdout(few, 0.25) == 4
    with pytest.raises(ValueError, match="too few"):
        dataset.check_holdout(few, 1.0)


def test_logistic_regression_minimises_its_objective(spark):
    """Probabilities against plain gradient descent on the stated objective, over population-standardised features."""
    dev = vectors(spark, 90).selectExpr("id", "cast(substr(class_name, 2) as int) as y", "v").where("id % 7 <> 0 or y = 0")
    rows = dev.orderBy("id").collect()
    x, y = np.array([r.v for r in rows]), np.array([r.y for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    w = (len(y) / (3 * np.bincount(y)))[y]
    a, c, hot = np.zeros((6, 3)), np.zeros(3), np.eye(3)[y]
    for _ in range(20000):
        p = np.exp(x @ a + c)
        p /= p.sum(axis=1, keepdims=True)
        g = w[:, None] * (p - hot) / len(y)
        a, c = a - 0.5 * (x.T @ g + a / len(y)), c - 0.5 * g.sum(axis=0)
    got = np.array([r.probability for r in models.logistic(dev, dev, "v", "y").orderBy("id").collect()])
    assert np.abs(got - p).max() < 1e-3


@pytest.mark.parametrize("classes", [2, 3])
def test_linear_svm(spark, classes):
    """Predictions of plain subgradient descent on the hinge objective of each class."""
    dev = vectors(spark, 90, classes).selectExpr("id", "cast(substr(class_name, 2) as int) as y", "v")
    rows = dev.orderBy("id").collect()
    x, y = np.array([r.v for r in rows]), np.array([r.y for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    margins = []
    for c in range(classes):
        t, a, b = np.where(y == c, 1, -1), np.zeros(6), 0.0
        for i in range(1, 20001):
            on = t * (x @ a + b) < 1
            a, b = a - (a / len(y) - (t * on) @ x / len(y)) / i**0.5, b + (t * on).mean() / i**0.5
        margins.append(x @ a + b)
    got = models.linear_svm(dev, dev, "v", "y").orderBy("id").collect()
    said = np.array([r.prediction for r in got])
    assert (said == np.argmax(margins, axis=0)).mean() >= 0.97
    p = np.array([r.probability for r in got])
    assert p.shape[1] == classes and np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == said).all()


def test_softmax_and_l1_by_row(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [-1.0, 1.0]), (2, []), (3, None), (4, [0.0, 0.0])]
    got = {r.id: r for r in spark.createDataFrame(rows, "id int, v array<double>").select("id", V.softmax(F.col("v")).alias("s"), V.l1_normalise(F.col("v")).alias("n"), V.l1_normalise(F.col("v"), 0.0).alias("z")).collect()}
    assert got[0].s == pytest.approx((np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()).tolist()) and got[0].n == pytest.approx([1 / 6, 1 / 3, 1 / 2])
    assert got[1].z == [-1.0, 1.0] and got[2].s == [] and got[3].s is None and got[4].n == [0.0, 0.0] and got[4].z == [0.0, 0.0]


def png(rgb: np.ndarray) -> bytes:
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images(spark, tmp_path):
    for name in ("a/x.png", "a/deep/y.PNG", "b/z.png", "b/note.txt", ".hid/w.png"):
        path = tmp_path / "dev" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(np.full((40, 50, 3), (255, 0, 0))))
    flat = images.scan(spark, str(tmp_path), "dev", dataset.classes(spark.createDataFrame([("a",), ("b",)], "class_name string")))
    assert [r.file_name for r in flat.collect()] == ["x.png", "z.png"]
    nested = images.scan(spark, str(tmp_path), "dev", nested=True)
    assert {r.file_name for r in nested.collect()} == {"x.png", "y.PNG", "z.png"}
    assert images.scan(spark, str(tmp_path), "none", nested=True).columns == images.RECORD.names
    (tmp_path / "dev" / "empty").mkdir()
    assert [tuple(r) for r in images.class_directories(spark, str(tmp_path), "dev").collect()] == [(0, ".hid"), (1, "a"), (2, "b"), (3, "empty")]
    row = images.features(spark, flat, str(tmp_path / "dev")).first()
    assert (len(row.color), len(row.hog), len(row.lbp), len(row["all"])) == (160, 900, 10, 1070)
    assert max(row.color) == pytest.approx(1, abs=1e-6) and max(row.hog) == 0


def test_orientation(spark, tmp_path):
    """A turned image with its orientation stated has the descriptors of the upright one; the main variant takes it as it is."""
    tiff = lambda n, o: (b"II*\0" if o == "<" else b"MM\0*") + struct.pack(o + "IHHHIHH", 8, 1, 0x0112, 3, 1, n, 0)
    rgb = np.random.default_rng(1).integers(0, 256, (40, 50, 3))
    shapes = {1: rgb, 2: rgb[:, ::-1], 3: rgb[::-1, ::-1], 4: rgb[::-1], 5: rgb.transpose(1, 0, 2), 6: np.rot90(rgb), 7: np.rot90(rgb, 2).transpose(1, 0, 2), 8: np.rot90(rgb, -1)}
    for n, stored in shapes.items():
        assert (images.upright(stored, n) == rgb).all()
        raw = png(stored)
        data = tiff(n, "<>"[n % 2])
        chunk = struct.pack(">I", len(data)) + b"eXIf" + data + struct.pack(">I", zlib.crc32(b"eXIf" + data))
        raw = raw[:33] + chunk + raw[33:]
        assert images.orientation(raw) == n and images.orientation(b"\xff\xd8\xff\xe0\0\4xx\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data) == n
        path = tmp_path / "dev" / "a" / f"{n}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    assert images.orientation(b"") == images.orientation(b"\xff\xd8\xff\xe1\0") == images.orientation(b"GIF89a") == 1
    records = images.scan(spark, str(tmp_path), "dev")
    found = {r.file_name: r["all"] for r in images.features(spark, records, str(tmp_path / "dev"), describe.WORKSHOP).collect()}
    assert len(found) == 8 and all(x == pytest.approx(found["1.png"], abs=1e-5) for x in found.values())
    assert len({tuple(r["all"]) for r in images.features(spark, records, str(tmp_path / "dev")).collect()}) > 1


def test_hsv_against_the_standard_library():
    rgb = np.random.default_rng(0).integers(0, 256, (64, 64, 3))
    rgb[0] = rgb[0, :, :1]  # greys
    got = np.round(describe.hsv((rgb / 255).astype(np.float32)) * 255).astype(int)
    want = np.array([[[int(c * 255 + 1e-9) for c in colorsys.rgb_to_hsv(*(p / 255))] for p in row] for row in rgb])
    assert np.abs(got - want).max() <= 1 and (got == want).mean() > 0.99
    flat = describe.colour((rgb / 255).astype(np.float32), describe.MAIN)
    counts = np.zeros((10, 4, 4))
    for h, s, v in got.reshape(-1, 3) / 255:
        counts[min(int(h * 10), 9), min(int(s * 4), 3), min(int(v * 4), 3)] += 1
    assert np.abs(flat - counts.ravel() / counts.sum()).max() < 1e-3


def test_gradients_against_loops():
    d = describe.MAIN
    x = np.random.default_rng(3).random((96, 96))
    cells = np.zeros((6, 6, 9))
    for i in range(96):
        for j in range(96):
            gy = x[i + 1, j] - x[i - 1, j] if 0 < i < 95 else 0.0
            gx = x[i, j + 1] - x[i, j - 1] if 0 < j < 95 else 0.0
            cells[i // 16, j // 16, min(int(math.degrees(math.atan2(gy, gx)) % 180 / 20), 8)] += math.hypot(gx, gy) / 256
    out = []
    for i in range(5):
        for j in range(5):
            v = [cells[i + a, j + b, o] for a in range(2) for b in range(2) for o in range(9)]
            v = [min(y / math.sqrt(sum(z * z for z in v) + 1e-10), 0.2) for y in v]
            out += [y / math.sqrt(sum(z * z for z in v) + 1e-10) for y in v]
    assert np.allclose(describe.hog(x, d), out, atol=1e-6)


def test_patterns_against_loops():
    x = np.random.default_rng(4).integers(0, 256, (24, 20)) / 255
    level = lambda i, j: math.floor(x[i, j] * 255 + 1e-6) if 0 <= i < 24 and 0 <= j < 20 else 0
    counts = [0] * 10
    for i in range(24):
        for j in range(20):
            bits = []
            for a in range(8):
                r, c = round(i - math.sin(math.pi * a / 4), 5), round(j + math.cos(math.pi * a / 4), 5)
                r0, c0 = math.floor(r), math.floor(c)
                near = [(level(r0 + m, c0 + n), (r - r0 if m else 1 - r + r0) * (c - c0 if n else 1 - c + c0)) for m in (0, 1) for n in (0, 1)]
                bits.append(sum(v * w for v, w in near) >= level(i, j) - 1e-9)
            counts[sum(bits) if sum(bits[k] != bits[k - 1] for k in range(8)) <= 2 else 9] += 1
    assert np.allclose(describe.lbp(x, describe.MAIN), np.array(counts) / sum(counts), atol=1e-6)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 99))
def test_descriptors(height, width, seed):
    rgb = np.random.default_rng(seed).random((height, width, 3)).astype(np.float32)
    found = describe.describe(rgb, describe.WORKSHOP)
    assert len(found["all"]) == 1422 and found["color"].sum() == pytest.approx(1, abs=1e-4) and found["lbp"].sum() == pytest.approx(1, abs=1e-4)

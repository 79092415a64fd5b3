"""Nearest neighbours by cosine distance, and their vote.

Two plans with equal results: ``neighbours`` deals both sides to a grid of blocks, compares a block of queries with a block
of training rows in matrix products, and sends k rows a query and block on; nothing is broadcast, and what a task holds is
bounded by the sizes of blocks.  ``neighbours_sql`` states the same with higher-order functions.
Distances are rounded to 9 places before ranking and ties go to the lower training id, so both plans and any engine agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import vectors as V

NEIGHBOUR = "qid long, tid long, d double"


def feature_stats(rows: DataFrame, vector: str) -> DataFrame:
    """(pos, mean, deviation): population statistics by position, from 1, of vectors of one length; null vectors are left out.

    One aggregation over whole vectors; none is taken apart into rows.
    """
    stats = rows.where(F.col(vector).isNotNull()).select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(V.doubles(vector))).alias("s"))
    # The summary divides by n - 1.
    pairs = F.zip_with(vector_to_array(F.col("s.mean")), vector_to_array(F.col("s.variance")), lambda m, v: F.struct(m.alias("mean"), v.alias("v")))
    stats = stats.select(F.posexplode(pairs).alias("p", "x"), F.col("s.count").alias("n"))
    return stats.select((F.col("p") + 1).alias("pos"), F.col("x.mean").alias("mean"), F.sqrt(F.col("x.v") * (F.col("n") - 1) / F.col("n")).alias("deviation"))


def standardiser(fit: DataFrame, vector: str):
    """A function (rows, out) that standardises vectors by the statistics of fit alone; only these, two numbers a position, reach the driver, once."""
    stats = feature_stats(fit, vector).orderBy("pos").collect()
    mean, deviation = (F.lit([r[c] for r in stats]).cast("array<double>") for c in ("mean", "deviation"))
    return lambda rows, out="z": rows.withColumn(out, V.standardise(V.doubles(vector), mean, deviation))


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit rows; zero vectors as they are."""
    x = np.array(vectors.to_pylist(), np.float64)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _nearest(q: np.ndarray, t: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, tid, d) of the k smallest of each query among candidates; equal distances rank by id."""
    order = np.lexsort((t, d, q))
    q, t, d = q[order], t[order], d[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], t[keep], d[keep]


def neighbours(queries: DataFrame, train: DataFrame, key: str, vector: str, k: int, block: int = 16384, tile: int = 1024) -> DataFrame:
    """(qid, tid, d, r): the k nearest training rows of each query; block rows at most, or about, are held of either side."""

    def compare(_, left: pa.Table, right: pa.Table) -> pa.Table:
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(left) and len(right):
            q, t, x, y = left["id"].to_numpy(), right["id"].to_numpy(), _unit(left["v"]), _unit(right["v"])
            parts = [best]
            for a in range(0, len(q), tile):
                own = [best]
                for b in range(0, len(t), 4 * tile):
                    d = np.maximum(np.round(1 - x[a : a + tile] @ y[b : b + 4 * tile].T, 9), 0)
                    worst = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1 :][:, :1]
                    i, j = np.nonzero(d <= worst)
                    own.append((q[a + i], t[b + j], d[i, j]))
                parts.append(_nearest(*map(np.concatenate, zip(*own)), k))
            best = list(map(np.concatenate, zip(*parts)))
        return pa.table({"qid": best[0], "tid": best[1], "d": best[2]})

    def dealt(rows: DataFrame, own: str, other: str, blocks: int, others: int) -> DataFrame:
        found = rows.select(F.col(key).cast("long").alias("id"), V.doubles(vector).alias("v"))
        return found.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    n_queries, n_train = (max(1, math.ceil(df.count() / block)) for df in (queries, train))
    left = dealt(queries, "q", "t", n_queries, n_train).select("id", "v", F.col("q").cast("int"), "t").groupBy("q", "t")
    right = dealt(train, "t", "q", n_train, n_queries).select("id", "v", "q", F.col("t").cast("int")).groupBy("q", "t")
    return _ranked(left.cogroup(right).applyInArrow(compare, NEIGHBOUR), k)


def neighbours_sql(queries: DataFrame, train: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``neighbours`` in DataFrame functions alone, for query sets that are small."""
    q = queries.select(F.col(key).alias("qid"), V.doubles(vector).alias("qv"))
    t = train.select(F.col(key).alias("tid"), V.doubles(vector).alias("tv"))
    d = F.greatest(F.round(V.cosine_distance(F.col("qv"), F.col("tv")), 9), F.lit(0.0))
    return _ranked(q.crossJoin(t).select("qid", "tid", d.alias("d")), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("qid").orderBy("d", "tid"))
    return found.withColumn("r", r).where(F.col("r") <= k)


def vote(near: DataFrame, k: int) -> DataFrame:
    """(qid, class_index, p): inverse-distance votes of the first k neighbours; where one has distance 0, only such count."""
    exact = F.min("d").over(Window.partitionBy("qid")) == 0
    weight = F.when(exact, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("d")))
    sums = near.where(F.col("r") <= k).withColumn("w", weight).groupBy("qid", "class_index").agg(F.sum("w").alias("w")).where("w > 0")
    return sums.select("qid", "class_index", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("qid")), 9).alias("p"))


def scores(votes: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """votes for every query (qid, true_index) and every class (class_index, class_name), zero where none was cast."""
    grid = queries.crossJoin(classes)  # the classes are few
    return grid.join(votes, ["qid", "class_index"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))

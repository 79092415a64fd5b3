"""Histograms over columns; bins without rows are filled from the bin table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import bin_of


def histogram(rows: DataFrame, axes: list[tuple[str, float, float, int]]) -> DataFrame:
    """(bin, n, mass) over the grid of axes (column, low, high, bins), flattened with the first axis slowest."""
    flat, size = F.lit(0), 1
    for column, low, high, bins in axes:
        flat, size = flat * bins + bin_of(F.col(column).cast("double"), low, high, bins), size * bins
    counts = rows.select(flat.cast("int").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("bin"))
    filled = grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return filled.crossJoin(counts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"))).select("bin", "n", (F.col("n") / (F.col("total") + 1e-8)).alias("mass"))

"""Vector and array expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def standardise(v: Column, mean: Column, deviation: Column) -> Column:
    """(v - mean) / deviation by position; a deviation of zero divides by one."""
    centred = F.zip_with(v, mean, lambda x, m: x - m)
    return F.zip_with(centred, deviation, lambda x, s: x / F.when(s == 0, 1.0).otherwise(s))


def once(of: Column, value: Column, then) -> Column:
    """then(of, value), with value computed once and not anew for each element that a lambda in then visits."""
    return F.transform(F.array(F.struct(of.alias("of"), value.alias("value"))), lambda s: then(s.getField("of"), s.getField("value")))[0]


def l1_normalise(v: Column, epsilon: float = 1e-8) -> Column:
    """v / (sum + epsilon); with epsilon 0, v where the sum is not positive."""
    if epsilon:
        return once(v, total(v) + epsilon, lambda u, s: F.transform(u, lambda x: x / s))
    return once(v, total(v), lambda u, s: F.when(s > 0, F.transform(u, lambda x: x / s)).otherwise(u))


def softmax(v: Column) -> Column:
    """exp(x - max) over their sum; each element is visited a fixed number of times."""
    shifted = once(v, F.array_max(v), lambda u, m: F.transform(u, lambda x: F.exp(x - m)))
    return F.transform(F.array(shifted), lambda e: once(e, total(e), lambda u, s: F.transform(u, lambda x: x / s)))[0]


def two_columns(decision: Column) -> Column:
    """A binary decision value as a pair of scores."""
    return F.array(-decision, decision)


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin number of a value in [low, high]; the last bin is closed on the right, values outside have none."""
    raw = F.floor((value - low) / (high - low) * bins)
    return F.when(value.between(low, high), F.least(raw, F.lit(bins - 1)).cast("int"))

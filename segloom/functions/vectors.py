"""Vectors as array columns: products, norms, softmax, and means over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column | str, floor: float = 1e-12) -> Column:
    """The vector by its length, or by ``floor`` if that is more; the length is computed once."""
    return F.transform(F.array(F.greatest(norm(a), F.lit(floor))), lambda n: F.transform(_c(a), lambda x: x.cast("double") / n))[0]


def softmax(a: Column | str) -> Column:
    """Shifted by the maximum."""
    shifted = F.transform(F.array(F.array_max(_c(a))), lambda m: F.transform(_c(a), lambda x: F.exp(x.cast("double") - m.cast("double"))))[0]
    return F.transform(F.array(shifted), lambda e: F.transform(F.array(F.aggregate(e, F.lit(0.0), lambda s, x: s + x)), lambda t: F.transform(e, lambda x: x / t))[0])[0]


def sigmoid(x: Column | str) -> Column:
    """D2."""
    return 1.0 / (1.0 + F.exp(-_c(x)))


def logsumexp(a: Column | str) -> Column:
    return F.transform(F.array(F.array_max(_c(a)).cast("double")), lambda m: m + F.log(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - m))))[0]


def argmax(a: Column | str) -> Column:
    """The lowest place of the largest value."""
    return F.array_position(_c(a), F.array_max(_c(a))) - 1


def vector_mean(df: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """Rows (by, vec): the mean vector of each group; components are averaged before the shuffle."""
    parts = df.select(*by, F.posexplode(vec).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vec))

"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column, dimensions: int | None = None) -> Column:
    """True for a non-empty vector (of that many dimensions) of finite numbers, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    right = (F.size(v) == dimensions) if dimensions else (F.size(v) > 0)
    return F.coalesce(right & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def norm(v: Column) -> Column:
    """Euclidean length, in double."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v / (length + 1e-9); a zero vector stays zero."""
    n = norm(v) + F.lit(1e-9)
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors."""
    return dot(unit(a), unit(b))


def sub_bucket(v: Column, dims: int = 10, buckets: int = 50) -> Column:
    """Second-level bucket of a large one: a thousand times the sum of the first dimensions, cut to a whole number, modulo."""
    total = F.aggregate(F.slice(v, 1, dims), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.pmod((total * 1000).cast("bigint"), F.lit(buckets)).cast("int")


def embeddings_of(ids: DataFrame, vectors: DataFrame, dimensions: int | None = None) -> DataFrame:
    """(id, embedding): the usable vector of every id that has one, as stored (of an id with several the smallest)."""
    own = vectors.where(usable(F.col("embedding"), dimensions)).groupBy("id").agg(F.min("embedding").alias("embedding"))
    return ids.select("id").distinct().join(own, "id")


def vectors_of(ids: DataFrame, vectors: DataFrame, dimensions: int | None = None) -> DataFrame:
    """(id, v): the unit vector of every id that has a usable one (of an id with several the smallest)."""
    return embeddings_of(ids, vectors, dimensions).select("id", unit(F.col("embedding")).alias("v"))

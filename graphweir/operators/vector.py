"""Exact cosine search over dense vectors; ``vector_index`` has the stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for null vectors, vectors of different lengths, and zero vectors."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def search(rows: DataFrame, vector: str, query: list[float], cutoff: float = 0.7, limit: int = 5, tie: str = "vec_id") -> DataFrame:
    """The rows nearest to ``query`` by cosine, at least ``cutoff``, best first; ties by ``tie``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.filter(F.col(vector).isNotNull()).withColumn("similarity_score", cosine(F.col(vector), q))
    return scored.filter(F.col("similarity_score") >= cutoff).orderBy(F.desc("similarity_score"), tie).limit(limit)

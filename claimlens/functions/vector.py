"""Column expressions over dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two arrays, summed in double in index order."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


def cosine_from_l2(squared_distance: Column | str) -> Column:
    """Cosine similarity of unit vectors from their squared distance."""
    return 1.0 - (F.col(squared_distance) if isinstance(squared_distance, str) else squared_distance) / 2.0

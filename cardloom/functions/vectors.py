"""Vector functions over array<float>; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_column


def dot(a: Column | str, b: Column | str) -> Column:
    both = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column | str, floor: float = 0.0) -> Column:
    """Unit length; a norm below the floor counts as the floor."""
    a = as_column(a)
    length = F.greatest(norm(a), F.lit(floor)) if floor else norm(a)
    lengths = F.array_repeat(length, F.size(a))  # once a vector: inside the lambda it would be computed for each number
    return F.zip_with(a, lengths, lambda x, n: x.cast("double") / n)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def prefix(a: Column | str, size: int) -> Column:
    """The leading dimensions, at unit length again."""
    return normalized(F.slice(as_column(a), 1, size))


def mean_pool(vectors: Column | str) -> Column:
    """Mean of an array of vectors."""
    v = as_column(vectors)
    total = F.aggregate(F.slice(v, 2, F.size(v)), F.transform(v[0], lambda x: x.cast("double")), lambda s, x: F.zip_with(s, x, lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / F.size(v))


def last_token(vectors: Column | str, mask: Column | str) -> Column:
    """The vector at the last position whose mask is 1, wherever the padding is."""
    kept = F.filter(F.arrays_zip(as_column(vectors).alias("v"), as_column(mask).alias("m")), lambda x: x["m"] == 1)
    return F.element_at(kept, -1)["v"]

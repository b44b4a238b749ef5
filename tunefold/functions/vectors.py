"""Vector arithmetic as column expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(_c(v), lambda x: x * x)))


def normalized(v: Column | str) -> Column:
    """Of length one; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: x / n)).otherwise(_c(v))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine(a, b)


def weighted(v: Column | str, weights: list[float]) -> Column:
    """Each element times its weight (the weight of its group)."""
    return F.zip_with(_c(v), F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)


def _scaled(v: Column, eps: float) -> Column:
    length = norm(v) + F.lit(eps)
    return F.transform(v, lambda x: x / length)


def residual(v: Column | str, center: Column | str, groups: list[int], normalize: bool = True, eps: float = 1e-8) -> Column:
    """v - center; each group of elements then divided by its length plus eps."""
    r = F.zip_with(_c(v), _c(center), lambda x, y: x - y)
    if not normalize:
        return r
    parts, at = [], 1
    for n in groups:
        parts.append(_scaled(F.slice(r, at, n), eps))
        at += n
    return F.concat(*parts)


def nearest(v: Column | str, codebook: list[tuple[int, list[float]]]) -> Column:
    """(d, slot) of the nearest center of a small codebook; the lowest slot among equals. No shuffle."""
    options = [F.struct(euclidean(v, F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(k).alias("slot")) for k, c in codebook]
    return F.array_min(F.array(*options))

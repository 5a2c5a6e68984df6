"""Vector similarity as JVM expressions, and blockwise in numpy where all pairs are wanted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-6


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def normalise(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(NORM_FLOOR))
    return F.transform(_doubles(a), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine, 0 where a vector has no length."""
    d = norm(a) * norm(b)
    return F.when(d == 0, 0.0).otherwise(dot(a, b) / F.nullif(d, F.lit(0.0)))


def to_unit(v: Column) -> Column:
    """[-1, 1] to [0, 1], clamped."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v + 1) / 2)))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance) of the normalised vectors."""
    gap = F.zip_with(normalise(a), normalise(b), lambda x, y: x - y)
    return 1 / (1 + F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)))


def similarity(a: Column, b: Column, kind: str = "cosine") -> Column:
    table = {"cosine": cosine, "cosine01": lambda x, y: to_unit(cosine(x, y)), "l2": l2_similarity, "dot": dot}
    if kind not in table:
        raise ValueError(f"unknown similarity {kind}")
    return table[kind](a, b)


def ensemble(first: Column, second: Column) -> Column:
    return (first + second) / 2


def standardised_mse(a: Column, b: Column, eps: float = 1e-5) -> Column:
    """Mean squared difference of two channels after each is centred and scaled by its
    unbiased standard deviation."""

    def scaled(v: Column) -> Column:
        n = F.size(v)
        mean = F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x) / n
        var = F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.greatest(n - 1, F.lit(1))
        return F.transform(_doubles(v), lambda x: (x - mean) / F.sqrt(var + eps))

    gaps = F.zip_with(scaled(a), scaled(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_pool(tokens: Column, width: int) -> Column:
    """Mean of an array of vectors, per dimension."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.element_at(t, i).cast("double")) / F.size(tokens))


def sigmoid(x: Column, bound: float = 60.0) -> Column:
    # greatest and least skip nulls, so a null must be kept apart
    return F.when(x.isNotNull(), 1 / (1 + F.exp(F.least(F.lit(bound), F.greatest(F.lit(-bound), -x)))))


def binary_softmax(log_one: Column, log_zero: Column) -> Column:
    return sigmoid(log_one - log_zero)

"""Rows that hold a vector: element-wise expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(v: Column | str) -> Column:
    return F.forall(v, finite)


def total(v: Column | str, of=lambda x: x) -> Column:
    """Sum in order, in double precision."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + of(x.cast("double")))


def gather(v: Column | str, positions: Column) -> Column:
    """Elements at 0-based positions."""
    return F.transform(positions, lambda i: F.get(v, i))


def affine(v: Column | str, center: Column | str, scale: Column | str) -> Column:
    return F.zip_with(F.zip_with(v, center, lambda x, c: x - c), scale, lambda d, s: d / s)


def squared_error(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x - y), lambda d: d * d)


def huber(a: Column | str, b: Column | str, delta: float = 1.0) -> Column:
    def of(d: Column) -> Column:
        return F.when(F.abs(d) <= delta, d * d / 2).otherwise(delta * (F.abs(d) - delta / 2))

    return total(F.zip_with(a, b, lambda x, y: x - y), of) / F.size(a)


def cosine(a: Column | str, b: Column | str) -> Column:
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    size = F.sqrt(total(a, lambda x: x * x)) * F.sqrt(total(b, lambda x: x * x))
    return dot / F.greatest(size, F.lit(1e-8))


def softmax_cross_entropy(target: Column | str, prediction: Column | str, temperature: float = 1.0) -> Column:
    def logs(v):
        scaled = F.transform(v, lambda x: x / temperature)
        return F.transform(F.array(F.struct(scaled.alias("v"), F.array_max(scaled).alias("m"))), lambda s: F.transform(s["v"], lambda x: x - s["m"] - F.log(F.aggregate(s["v"], F.lit(0.0), lambda a, y: a + F.exp(y - s["m"])))))[0]

    return -total(F.zip_with(logs(target), logs(prediction), lambda t, p: F.exp(t) * p))


def masked(v: Column | str, key: Column, share: float, seed: int) -> Column:
    """Which elements a deterministic mask covers; at least the one with the smallest hash."""
    ranks = F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1_000_000)))
    return F.transform(ranks, lambda r: (r < int(share * 1_000_000)) | (r == F.array_min(ranks)))


def masked_squared_error(a: Column | str, b: Column | str, mask: Column | str) -> Column:
    pairs = F.filter(F.arrays_zip(F.zip_with(a, b, lambda x, y: x - y).alias("d"), mask.alias("m") if isinstance(mask, Column) else F.col(mask).alias("m")), lambda p: p["m"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["d"] * p["d"]) / F.size(pairs)

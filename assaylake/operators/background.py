"""Background of array intensities: each array is a normal background plus an exponential signal, and keeps its expected signal.

The background's mode is that of a kernel density, found again below it; its deviation is that of the values below the mode, and the
signal's mean the mode of what lies above it. The expected signal given what was measured is then closed: with a = x - mu - alpha sigma^2, a
plus sigma times the normal density over the normal distribution function, both at a / sigma. An array is one row and needs no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from assaylake.operators.sums import blocks

#: Points of a density.
POINTS = 1 << 14
_erfc = np.frompyfunc(math.erfc, 1, 1)


def bandwidth(x: np.ndarray) -> float:
    """0.9 times the lesser of deviation and quartile distance / 1.34, times n to the power of -1/5."""
    high = float(np.std(x, ddof=1)) if len(x) > 1 else 0.0
    q1, q3 = np.quantile(x, (0.25, 0.75))
    low = min(high, (q3 - q1) / 1.34) or high or abs(float(x[0])) or 1.0
    return 0.9 * low * len(x) ** -0.2


def mode(x: np.ndarray, points: int = POINTS) -> float:
    """Where an Epanechnikov density of the values is greatest: binned linearly, and smoothed by a transform over twice the range."""
    width = bandwidth(x)
    low, high = float(x.min()) - 3 * width, float(x.max()) + 3 * width
    step = (high - low) / (points - 1)
    at = (x - low) / step
    left = np.minimum(at.astype(np.int64), points - 2)
    share = at - left
    mass = np.bincount(left, 1 - share, 2 * points) + np.bincount(left + 1, share, 2 * points)
    reach = width * math.sqrt(5)  # a kernel of the deviation `width`
    off = np.arange(2 * points) * step
    off = np.minimum(off, 2 * points * step - off)
    kernel = np.maximum(1 - (off / reach) ** 2, 0)
    density = np.fft.irfft(np.fft.rfft(mass) * np.fft.rfft(kernel), 2 * points)[:points]
    return low + step * int(density.argmax())


def parameters(x: np.ndarray, points: int = POINTS) -> tuple[float, float, float]:
    """mu and sigma of the background, and alpha, the reciprocal of the signal's mean."""
    below = x[x < mode(x, points)]
    if len(below) < 2:
        raise ValueError("an array has no values below its mode")
    mu = mode(below, points)
    under, over = x[x < mu] - mu, x[x > mu] - mu
    if len(under) < 2 or not len(over):
        raise ValueError("an array has no values on both sides of its background")
    sigma = math.sqrt(float(under @ under) / (len(under) - 1)) * math.sqrt(2)
    return mu, sigma, 1 / mode(over, points)


def expected_signal(x: np.ndarray, mu: float, sigma: float, alpha: float) -> np.ndarray:
    a = x - mu - alpha * sigma * sigma
    z = a / sigma
    # Far below the background the ratio of density and distribution function is z + 1 / z to the precision of doubles.
    far = z < -30
    near = np.where(far, 0.0, z)
    ratio = np.exp(-near * near / 2) / math.sqrt(2 * math.pi) / (0.5 * _erfc(-near / math.sqrt(2)).astype(float))
    return np.where(far, sigma / np.maximum(-z, 1), a + sigma * ratio)


def corrected(df: DataFrame, key: str, values: str = "values", points: int = POINTS) -> DataFrame:
    """key, values of each array without its background, and mu, sigma, alpha. Values must be finite; what comes out must be, and positive."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, x in blocks(batch, 0, 1) if batch.num_rows else ():
                if not np.isfinite(x).all():
                    raise ValueError("an array has values that are not finite")
                found = [parameters(row, points) for row in x]
                out = [expected_signal(row, *p) for row, p in zip(x, found, strict=True)]
                if not all(np.isfinite(row).all() and (row > 0).all() for row in out):
                    raise ValueError("a corrected value is not finite and positive")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64())), *(pa.array(c, pa.float64()) for c in zip(*found, strict=True))], names=[key, values, "mu", "sigma", "alpha"])

    number = [StructField(n, DoubleType()) for n in ("mu", "sigma", "alpha")]
    return df.select(key, values).mapInArrow(go, StructType([df.schema[key], StructField(values, ArrayType(DoubleType())), *number]))

"""Small formulas of training runs: schedules, penalties, latent divergences, sizes and names."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake.functions.ids import slug

#: Scales of the kernel over which the divergence is averaged, and its guard.
SCALES, GUARD = (0.25, 0.5, 1.0, 2.0, 4.0), 1e-8


def log2_clipped(x: Column, least: float = 1e-6) -> Column:
    return F.log2(F.greatest(x, F.lit(least)))


def kl_weight(epoch: Column, beta: float, warmup: int) -> Column:
    """The weight of the divergence, rising linearly over the warm-up."""
    return F.lit(float(beta)) if warmup <= 0 else beta * F.least(F.lit(1.0), F.greatest(epoch.cast("double"), F.lit(0.0)) / float(warmup))


def cosine_rate(epoch: Column, rate: float, decay: int, floor: float) -> Column:
    """A learning rate that falls along half a cosine to a share `floor` of itself."""
    at = F.least(F.greatest(epoch.cast("double"), F.lit(0.0)), F.lit(float(decay))) / float(decay)
    return rate * (floor + (1 - floor) * (1 + F.cos(math.pi * at)) / 2)


def utc_stamp(x: Column) -> Column:
    """A timestamp for provenance and names of backups; sessions run in UTC."""
    return F.date_format(x, "yyyyMMdd'T'HHmmss'Z'")


def kl_to_standard_normal(mean: Column | str, log_variance: Column | str) -> Column:
    """Divergence of a diagonal normal distribution, summed over its dimensions."""
    terms = F.zip_with(mean, log_variance, lambda m, v: (m * m + F.exp(v) - v - 1) / 2)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def mmd(x: np.ndarray, prior: np.ndarray, scales: tuple[float, ...] = SCALES) -> float:
    """Mean discrepancy of two samples of equal size under inverse multiquadratic kernels of several scales."""
    n, dim = x.shape
    if n < 2:
        return 0.0
    apart = [np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0) for a, b in ((x, x), (prior, prior), (x, prior))]

    def at(scale: float) -> float:
        c = 2.0 * max(dim, 1) * scale
        xx, yy, xy = (c / (c + d + GUARD) for d in apart)
        return float((xx.sum() - np.trace(xx) + yy.sum() - np.trace(yy)) / (n * (n - 1)) - 2 * xy.mean())

    return float(np.mean([at(s) for s in scales]))


def kernel_l2(kernels: dict[str, np.ndarray], weight: float, output: str = "to_output") -> float:
    """The penalty on all kernels but that of the output."""
    return weight * float(sum((k.astype(float) ** 2).sum() for name, k in kernels.items() if not name.startswith(output))) if weight > 0 else 0.0


def autoencoder_parameters(inputs: Column, widths: Column, latent: Column) -> Column:
    """Weights and biases of a dense encoder and its mirror image."""
    inner = F.concat(F.array(inputs), widths, F.array(latent))
    pairs = F.transform(F.sequence(F.lit(0), F.size(inner) - 2), lambda k: F.struct(F.get(inner, k).alias("a"), F.get(inner, k + 1).alias("b")))
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, p: s + 2 * p["a"].cast("bigint") * p["b"] + p["a"] + p["b"])


def pca_name(method: Column, dimension: Column, preprocessings: int, dimensions: int) -> Column:
    """A baseline's name, with the method and the dimension only where there are several."""
    return F.concat(F.lit("pca"), *([F.lit("_"), slug(method)] if preprocessings > 1 else []), *([F.lit("_d"), dimension.cast("string")] if dimensions > 1 else []))

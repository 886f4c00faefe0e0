"""Background correction against integrals, and median polish of dealt cells against the plain one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import background, models


def test_the_mode_is_that_of_the_plain_density():
    rng = np.random.default_rng(1)
    for x in (rng.normal(5, 1, 800), rng.exponential(3, 500), np.concatenate([rng.normal(0, 1, 300), rng.normal(9, 0.4, 400)])):
        width = background.bandwidth(x)
        grid = np.linspace(x.min() - 3 * width, x.max() + 3 * width, background.POINTS)
        plain = np.array([np.maximum(1 - ((g - x) / (width * math.sqrt(5))) ** 2, 0).sum() for g in grid[::8]])
        assert background.mode(x) == pytest.approx(grid[::8][plain.argmax()], abs=(x.max() - x.min()) / 400)


def test_the_expected_signal_is_the_integral():
    mu, sigma, alpha = 100.0, 15.0, 1 / 250
    s = np.linspace(0, 4000, 400_001)
    for x in (20.0, 95.0, 130.0, 900.0):
        weight = np.exp(-alpha * s - (x - s - mu) ** 2 / (2 * sigma**2) + (max(x - mu, 0) * alpha))
        assert background.expected_signal(np.array([x]), mu, sigma, alpha)[0] == pytest.approx(np.trapezoid(s * weight, s) / np.trapezoid(weight, s), rel=1e-3)
    far = background.expected_signal(np.array([-1e4, -400.0, -355.0, -340.0]), mu, sigma, alpha)
    assert (far > 0).all() and (np.diff(far) > 0).all()


def test_arrays_are_corrected_apart(spark):
    rng = np.random.default_rng(2)
    arrays = [rng.normal(m, 6, 20_000) + rng.exponential(e, 20_000) * (rng.random(20_000) < 0.3) for m, e in ((100, 400), (60, 150))]  # most cells are background
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(arrays)], "id bigint, values array<double>")
    got = {r.id: r for r in background.corrected(df, "id").collect()}
    for k, x in enumerate(arrays):
        found = background.parameters(x)
        assert (got[k].mu, got[k].sigma, got[k].alpha) == pytest.approx(found)
        assert np.allclose(got[k]["values"], background.expected_signal(x, *found)) and min(got[k]["values"]) > 0
        assert (np.diff(np.array(got[k]["values"])[np.argsort(x)]) >= 0).all()
    assert got[0].mu == pytest.approx(100, rel=0.05) and got[1].mu == pytest.approx(60, rel=0.05)
    with pytest.raises(Exception, match="not finite"):
        background.corrected(df.withColumn("values", F.transform("values", lambda x: x * float("nan"))), "id").collect()


def test_dealt_cells_are_polished_as_one_table(spark):
    rng = np.random.default_rng(3)
    rows = [(p, c, s, float(p + rng.normal() + c * 0.3 - s * 0.1)) for p in (1, 2) for c in range(5) for s in range(7 if p == 1 else 4)]
    df = spark.createDataFrame(rows, "probe_set bigint, cell bigint, sample bigint, value double").repartition(3)
    values = lambda frame: {(r.probe_set, r.kind, r.id): r.effect for r in frame.collect()}
    whole, apart = values(models.median_polish(df, steps=3)), values(models.median_polish(df, steps=3, local=0))
    assert apart == pytest.approx(whole, abs=1e-9) and len(whole) == 2 + 10 + 11
    mixed = values(models.median_polish(df, steps=3, local=25))
    assert mixed == pytest.approx(whole, abs=1e-9)


def test_frozen_effects_give_the_polish_s_summaries(spark):
    rng = np.random.default_rng(4)
    rows = [(1, c, s, float(7 + rng.normal() * 0.3 + c - 0.5 * s)) for c in range(9) for s in range(11)]
    df = spark.createDataFrame(rows, "probe_set bigint, cell bigint, sample bigint, value double")
    effects, off = models.frozen_effects(df)
    assert effects.count() == 9 and off.first().off <= 1e-7

"""Reports over metrics whose sums of doubles come out otherwise in each evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from assaylake.operators import reports


def test_a_baseline_never_differs_from_itself(spark):
    noise = F.udf(lambda: random.SystemRandom().random() * 1e-14, "double").asNondeterministic()
    folds = spark.range(40).select(F.lit(0).alias("repeat"), F.col("id").alias("fold"))
    metrics = folds.crossJoin(spark.createDataFrame([("time", 4.0), ("a", 3.0)], "model_id string, level double")).select("model_id", "repeat", "fold", (F.col("level") + noise()).alias("rmse"))
    found = {r.model_id: r for r in reports.summarize(reports.delta_to(metrics, "time", ["repeat", "fold"]), ["model_id"]).collect()}
    assert (found["time"].better_fraction, found["time"].mean_delta, found["time"].n_folds) == (0.0, 0.0, 40)
    assert (found["a"].better_fraction, found["a"].mean_delta) == (1.0, pytest.approx(1.0))


def test_a_fold_has_one_baseline(spark):
    twice = spark.createDataFrame([("time", 0, 5.0), ("time", 0, 6.0), ("a", 0, 3.5)], "model_id string, fold int, rmse double")
    with pytest.raises(Exception, match="several baselines"):
        reports.delta_to(twice, "time", ["fold"]).collect()

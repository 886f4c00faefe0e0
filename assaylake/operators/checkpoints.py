"""Checkpoints of training runs by their metadata alone: what each last validated, and why some are passed over.

A record has run, path, history (arrays by validation), policy, best (the declared best score) and what else is carried along, or is broken.
One that cannot be read or contradicts itself does not stop a scan: it gets a row with its problem instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions import vectors
from assaylake.operators import order

#: The policy a score must have been selected by. Fixed values.
POLICY = {"metric": "clean_reconstruction_mse", "aggregation": "donor_balanced", "uncertainty": "sample_sd_across_donor_mean_mse"}
WEIGHT, RELATIVE, ABSOLUTE = 0.5, 1e-9, 1e-12
SERIES = ("val_mse", "selection_score", "first_mse", "second_mse", "second_sd")
HISTORY = "struct<" + ",".join(f"{c}:array<double>" for c in (*SERIES, "val_r2", "val_loss")) + ",val_epoch:array<bigint>>"
SCHEMA = f"run string, method string, architecture string, latent_dim bigint, input_dim bigint, epoch bigint, best double, history {HISTORY}, policy struct<metric:string,aggregation:string,uncertainty:string,uses_test:boolean,uses_outcomes:boolean,first_weight:double,second_weight:double>"


def read(spark: SparkSession, root: str) -> DataFrame:
    """The JSON records under a folder; one that cannot be parsed has its text in `broken`."""
    rows = spark.read.schema(f"{SCHEMA}, broken string").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", "true").option("multiLine", "true").json(root)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= ABSOLUTE + RELATIVE * F.abs(b)


def scanned(records: DataFrame) -> DataFrame:
    """The records with `problem`, null where there is none, and the last value of each series."""
    series = lambda c: F.col(f"history.{c}")
    last = lambda c: F.try_element_at(series(c), F.lit(-1))
    n = F.coalesce(F.size(series("val_mse")), F.lit(-1))
    at = lambda c: F.when(F.size(series(c)) >= n, F.get(series(c), n - 1))  # noqa: E731  a series may be shorter
    policy = F.lit(True)
    for field, value in POLICY.items():
        policy = policy & (F.col(f"policy.{field}") == value)
    policy = policy & ~F.col("policy.uses_test") & ~F.col("policy.uses_outcomes") & _close(F.col("policy.first_weight"), F.lit(WEIGHT)) & _close(F.col("policy.second_weight"), F.lit(WEIGHT))
    even = F.lit(True)
    for c in SERIES[1:]:
        even = even & (F.size(series(c)) == n)
    whole = F.lit(True)
    for c in SERIES[1:]:
        whole = whole & vectors.finite(last(c))
    agrees = _close(last("selection_score"), WEIGHT * last("first_mse") + WEIGHT * last("second_mse")) & _close(F.col("best"), last("selection_score"))
    sure = lambda x: F.coalesce(x, F.lit(False))
    problem = (
        F.when(F.col("broken").isNotNull() if "broken" in records.columns else F.lit(False), "unreadable").when(n < 1, "no validation").when(~sure(even & policy), "another policy")
        .when(~sure(whole), "not finite").when(~sure(agrees), "scores disagree")
    )
    return records.withColumn("problem", problem).withColumns({
        "validation_mse": last("val_mse"), "validation_r2": at("val_r2"), "validation_loss": F.coalesce(at("val_loss"), F.col("best")), "score": last("selection_score"), "first_mse": last("first_mse"),
        "second_mse": last("second_mse"), "second_sd": last("second_sd"), "best_epoch": F.coalesce(at("val_epoch"), F.col("epoch")),
    })


def ranked(found: DataFrame) -> DataFrame:
    """The sound records of a scan, in order of their score."""
    return order.numbered(found.filter("problem IS NULL").drop("problem"), [F.col("score"), F.col("run")])


def warnings(found: DataFrame) -> DataFrame:
    return found.filter("problem IS NOT NULL").select("run", "path", "problem")

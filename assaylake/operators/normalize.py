"""Normalization: standardization by dataset or by training rows, quantile reference, probe-set summaries, imputation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from assaylake.functions import vectors
from assaylake.operators import order, sums

#: A feature that varies no more than this is only centered.
FLAT, FOLD_FLAT = 1e-6, 1e-12


def long_form(df: DataFrame, *keys: str, values: str = "values") -> DataFrame:
    """A row for each element: keys, pos (0-based) and value in double precision."""
    return df.select(*keys, F.posexplode(values).alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def _safe(scale: Column, flat: float) -> Column:
    return F.when(scale > flat, scale).otherwise(1.0)


def fit_centers(df: DataFrame, group: list[str], flat: float = FLAT, values: str = "values") -> DataFrame:
    """For each group: center and scale arrays, mean and population deviation of each position.

    Vectors are summed whole in their tasks, so the shuffle holds a row for each group and task, whatever the number of rows.
    """
    return sums.moments(df, group, values).select(*group, F.col("mean").alias("center"), F.transform("sd", lambda s: _safe(s, flat)).alias("scale"))


def standardize(df: DataFrame, centers: DataFrame, group: list[str], values: str = "values") -> DataFrame:
    """values of each row by its group's center and scale. Few groups are broadcast by Spark's own size check."""
    joined = df.join(centers, group) if group else df.crossJoin(centers)
    return joined.withColumn(values, vectors.affine(vectors.doubles(values), "center", "scale")).drop("center", "scale")


def quantile_reference(df: DataFrame, values: str = "values") -> DataFrame:
    """Mean over rows of the k-th smallest value: rank (0-based), target. Values that are missing, not finite or not positive are refused."""
    fit = vectors.doubles(values)
    good = F.forall(fit, lambda x: vectors.finite(x) & (x > 0))
    checked = F.when(F.coalesce(good, F.lit(False)), F.array_sort(fit)).otherwise(F.raise_error(F.lit("a reference is fitted on finite positive values")).cast("array<double>"))
    return sums.moments(df.select(checked.alias(values)), [], values).select(F.posexplode("mean").alias("rank", "target"))


def apply_reference(df: DataFrame, target: DataFrame, key: str, values: str = "values", log: bool = True) -> DataFrame:
    """key and values: each row mapped to the reference, the k-th smallest to the k-th target, ties to the mean over their ranks; log2 of it by default.

    A row needs no other: the reference, as long as a vector, goes to every task.
    """
    wanted = np.array([r["target"] for r in target.orderBy("rank").collect()])  # one vector
    upto = np.concatenate([[0.0], np.cumsum(wanted)])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = next(sums.blocks(batch, 0, 1))[2]
            if x.shape[1] != len(wanted):
                raise ValueError("the reference is not as long as the vectors")
            if not (np.isfinite(x).all() and (x > 0).all()):
                raise ValueError("only finite positive values are mapped")
            sorted_ = np.argsort(x, axis=1, kind="stable")
            rising = np.take_along_axis(x, sorted_, axis=1)
            new = np.concatenate([np.ones((len(x), 1), bool), rising[:, 1:] != rising[:, :-1]], axis=1)
            at = np.arange(x.shape[1])
            first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
            last = np.minimum.accumulate(np.where(np.roll(new, -1, axis=1) | (at == len(wanted) - 1), at, len(wanted))[:, ::-1], axis=1)[:, ::-1]
            mean = np.where(first == last, wanted, (upto[last + 1] - upto[first]) / (last + 1 - first))
            out = np.empty_like(x)
            np.put_along_axis(out, sorted_, np.log2(mean) if log else mean, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=[key, values])

    return df.select(key, values).mapInArrow(mapped, StructType([df.schema[key], StructField(values, ArrayType(DoubleType()))]))


def probe_set_medians(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median of the cells of each probe set; a cell that is in it twice counts twice."""
    return rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))


def apply_frozen_effects(rows: DataFrame, effects: DataFrame, cell: list[str], by: list[str]) -> DataFrame:
    """Summary of new samples by frozen cell effects: median of log2(value) - effect."""
    return rows.join(effects, cell).groupBy(*by).agg(F.percentile(F.log2("value") - F.col("effect"), F.lit(0.5)).alias("summary"))


def delta_report(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How far two long tables are apart: n, max_abs, mean_abs, rmse."""
    d = F.abs(F.col("a") - F.col("b"))
    both = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), keys)
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"))


def impute_and_scale(rows: DataFrame, fold: list[str], feature: str = "feature", value: str = "value", train: str = "is_train") -> DataFrame:
    """Missing values by the training median of the fold, then training mean and population deviation; for every row.

    A missing value of a feature without any training value is an error."""
    medians = order.quantiles(rows.filter(train), [*fold, feature], value, (0.5,)).select(*fold, feature, F.get("q", F.lit(0)).alias("median"))
    empty = F.raise_error(F.lit("a feature has no training value in a fold")).cast("double")
    filled = rows.join(medians, [*fold, feature], "left").withColumn(value, F.coalesce(value, "median", empty)).drop("median")
    stats = filled.filter(train).groupBy(*fold, feature).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return filled.join(stats, [*fold, feature]).withColumn(value, (F.col(value) - F.col("m")) / _safe(F.col("s"), FOLD_FLAT)).drop("m", "s")

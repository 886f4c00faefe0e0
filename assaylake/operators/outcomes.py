"""Longitudinal outcomes: wide to long, completeness, matches with samples, fold features, mixed-model designs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions import ids, vectors
from assaylake.operators import order as places


#: Rows of a training fold that a bandwidth is found for: pairs grow with their square.
MOST = 5000


def wide_to_long(wide: DataFrame, times: dict[str, str] = ids.TIMES) -> DataFrame:
    """A row for each measurement; all other columns are kept, missing values dropped, times numbered in order."""
    there = [c for c in times if c in wide.columns]
    keep = [c for c in wide.columns if c not in there]
    rows = wide.unpivot(keep, there, "time_column", "egfr").filter("egfr IS NOT NULL")
    labels = F.create_map(*(F.lit(v) for c in there for v in (c, times[c])))
    order = F.create_map(*(F.lit(v) for k, t in enumerate(times.values()) for v in (t, k)))
    return rows.withColumn("time", F.element_at(labels, F.col("time_column"))).withColumn("time_ord", F.element_at(order, F.col("time"))).drop("time_column")


def any_measured(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(vectors.finite(F.col(c).cast("string").try_cast("double")), F.lit(False)) for c in columns))


def load_wide(table: DataFrame, key: str, columns: list[str], samples: DataFrame) -> DataFrame:
    """Outcomes of known samples with at least one value; ids normalized, an id that repeats is an error; with the donor."""
    rows = table.withColumn("patient", F.upper(ids.sample_id(F.col(key))))
    twice = rows.groupBy("patient").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(twice, "patient").withColumn("patient", F.when(F.col("n") == 1, F.col("patient")).otherwise(F.raise_error(F.lit("an id repeats")).cast("string"))).drop("n")
    rows = rows.join(samples, "patient", "left_semi").filter(F.coalesce(*columns).isNotNull())
    return rows.withColumn("donor", ids.donor_of_patient(F.col("patient")))


def match_summary(samples: DataFrame, clinical: DataFrame, outcomes: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row: samples, matched clinical ids, matched outcome ids, and those of them with any value."""
    one = lambda df, name: df.agg(F.countDistinct(key).alias(name))
    parts = [one(samples, "n_samples"), one(clinical.join(samples, key, "left_semi"), "clinical_matched"), one(outcomes.join(samples, key, "left_semi"), "outcome_matched"), one(outcomes.join(samples, key, "left_semi").filter(any_measured(columns)), "outcome_valid_matched")]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


def trajectory(long: DataFrame) -> DataFrame:
    by = ["time", "time_ord"]
    medians = places.quantiles(long, by, "egfr", (0.5,)).select(*by, F.get("q", F.lit(0)).alias("median"))
    return long.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(medians, by).select(*by, "median", "n")


def fold_design(assignments: DataFrame, long: DataFrame, features: DataFrame) -> DataFrame:
    """A row for each fold, patient and time: (repeat, fold, partition, patient, time, egfr, x)."""
    return assignments.join(long, "patient").join(features, "patient")


def time_design(order: Column, levels: int = 4) -> Column:
    """Intercept and treatment dummies; an unknown level is an error."""
    row = F.array(F.lit(1.0), *((order == k).cast("double") for k in range(1, levels)))
    return F.when(order.between(0, levels - 1), row).otherwise(F.raise_error(F.lit("an unknown time")).cast("array<double>"))


def whiten(df: DataFrame, group: str, column: str, ratio: float) -> DataFrame:
    """V^(-1/2) for V = I + ratio Z Z', closed form within each group."""
    stats = df.groupBy(group).agg(F.count(column).alias("_n"), F.sum(column).alias("_s"))
    k = (1 / F.sqrt(1 + F.lit(ratio) * F.col("_n")) - 1) / F.col("_n")
    return df.join(stats, group).withColumn(f"{column}_white", F.col(column) + k * F.col("_s")).drop("_n", "_s")


def role_counts(df: DataFrame, role: str, names: list[str]) -> DataFrame:
    """One row with a count for each role, 0 where there is none."""
    return df.agg(*(F.count_if(F.col(role) == n).alias(n) for n in names))


def group_counts(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Counts in a fixed order, zero-filled."""
    wanted = df.sparkSession.createDataFrame([(k, n) for k, n in enumerate(names)], f"ord int, {column} string")
    return wanted.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select("ord", column, F.coalesce("n", F.lit(0)).alias("n"))


def clinical_geometry(train: DataFrame, columns: list[str]) -> DataFrame:
    """For each variable: training median, mean and population deviation."""
    long = train.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "variable", "value")
    medians = places.quantiles(long, ["variable"], "value", (0.5,)).select("variable", F.get("q", F.lit(0)).alias("median"))
    return medians.join(long.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")), "variable")


def bandwidth(train: DataFrame, key: str, values: str) -> DataFrame:
    """Median of the positive distances between a cohort's rows, 1 if there is none. All pairs: a training fold of more than MOST rows is refused."""
    if train.limit(MOST + 1).count() > MOST:
        raise ValueError(f"a bandwidth is of at most {MOST} rows")
    a, b = train.select(F.col(key).alias("i"), F.col(values).alias("a")), train.select(F.col(key).alias("j"), F.col(values).alias("b"))
    d = a.join(b, F.col("i") < F.col("j")).select(F.sqrt(vectors.squared_error("a", "b")).alias("d")).filter("d > 0")
    return d.agg(F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(1.0)).alias("bandwidth"))


def tissue_pattern(biopsies: DataFrame) -> DataFrame:
    return biopsies.groupBy("donor").agg(F.array_join(F.array_sort(F.collect_set("tissue")), "").alias("pattern"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """A gapless 1-based index in a total order."""
    return places.numbered(df, [F.col(order)], "array_index", 1)

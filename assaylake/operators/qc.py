"""Quality control: whole-matrix scans, quantiles, clipped histograms, boxes, missingness, deterministic positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.functions import vectors
from assaylake.operators import order, sums


def scan_rows(df: DataFrame, key: str, values: str = "values") -> DataFrame:
    """For each row: counts of kinds of values, extremes, mean, population deviation, whether constant or all zero."""
    v = vectors.doubles(values)
    n = lambda test: F.size(F.filter(v, test))
    ok = F.filter(v, vectors.finite)
    mean = vectors.total(ok) / F.size(ok)
    return df.select(
        key, n(F.isnan).alias("n_nan"), n(lambda x: F.abs(x) == float("inf")).alias("n_inf"), n(lambda x: x == 0).alias("n_zero"), n(lambda x: x <= 0).alias("n_nonpositive"),
        F.size(ok).alias("n_finite"), F.array_min(ok).alias("low"), F.array_max(ok).alias("high"), mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), vectors.total(ok, lambda x: x * x) / F.size(ok) - mean * mean)).alias("sd"),
        (F.array_min(ok) == F.array_max(ok)).alias("constant"), ((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(x == 0, F.lit(False)))).alias("all_zero"), vectors.total(ok).alias("total"),
    )


def scan_features(df: DataFrame, values: str = "values") -> DataFrame:
    """For each position of the vectors: extremes, mean, and whether constant, all zero or not finite."""
    found = sums.moments(df, [], values)
    rows = found.select(F.posexplode(F.arrays_zip("low", "high", "mean", "n_not_finite")).alias("pos", "s")).select("pos", "s.*")
    low, high = F.col("low"), F.col("high")
    return rows.select("pos", "low", "high", "mean", (low == high).alias("constant"), F.coalesce((low == 0) & (high == 0), F.lit(False)).alias("all_zero"), "n_not_finite")


def scope_summary(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Quantiles 1, 25, 50, 75 and 99 %, mean and population deviation."""
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    out = out.join(order.quantiles(rows, by, value, (0.01, 0.25, 0.5, 0.75, 0.99)), by)
    return out.select(*by, *(F.get("q", F.lit(k)).alias(name) for k, name in enumerate(("q01", "q25", "q50", "q75", "q99"))), "mean", "sd", "n")


def histogram(rows: DataFrame, by: list[str], low: float, high: float, n_bins: int, value: str = "value") -> DataFrame:
    """Counts and densities over the values within two quantiles of their group; the last bin holds its upper edge."""
    edges = order.quantiles(rows, by, value, (low, high)).select(*by, F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
    inside = rows.join(edges, by).filter(F.col(value).between(F.col("lo"), F.col("hi"))).filter("hi > lo")
    width = (F.col("hi") - F.col("lo")) / n_bins
    bin_ = F.least(F.lit(n_bins - 1), F.floor((F.col(value) - F.col("lo")) / width)).cast("int")
    counts = inside.groupBy(*by, "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(*by)
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(every) * width)).select(*by, "bin", "n", "density")


def box(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Quartiles, and the outermost values within 1.5 times their distance. A group is a sample, as long as a vector."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*by, *(F.get("q", F.lit(k)).alias(f"q{k + 1}") for k in range(3)))
    near = rows.join(q, by).filter(F.col(value).between(F.expr("q1 - 1.5 * (q3 - q1)"), F.expr("q3 + 1.5 * (q3 - q1)")))
    return near.groupBy(*by, "q1", "q2", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def positions(n: Column, most: int) -> Column:
    """At most so many evenly spread positions of 0 .. n-1, each once, the last one included."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when(i == most - 1, n - 1).otherwise(F.floor(i * ((n - 1).cast("double") / F.lit(float(max(1, most - 1)))))).cast("bigint"))
    return F.when(n <= most, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array_distinct(spread))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of missing values of each column."""
    shares = df.agg(*((F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns))
    return shares.unpivot([], columns, "column_name", "percent")


def categories(df: DataFrame, column: str, most: int = 25) -> DataFrame:
    """The most frequent values, missing ones named so."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Missing")).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(most)


def first_of_each(df: DataFrame, key: str, by: str) -> DataFrame:
    return df.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(by))).filter("_at = 1").drop("_at")


def shared_bins(a: DataFrame, b: DataFrame, n_bins: int = 70, value: str = "value") -> DataFrame:
    """Densities of two value sets on bins that span the middle 99 % of both: side, bin, n, density."""
    both = a.select(F.lit("sample").alias("side"), value).unionByName(b.select(F.lit("reference").alias("side"), value))
    span = order.quantiles(both, ["side"], value, (0.005, 0.995)).agg(F.min(F.get("q", F.lit(0))).alias("lo"), F.max(F.get("q", F.lit(1))).alias("hi"))
    rows = both.crossJoin(F.broadcast(span)).filter(F.col(value).between(F.col("lo"), F.col("hi")) & (F.col("hi") > F.col("lo")))  # one row
    width = (F.col("hi") - F.col("lo")) / n_bins
    counts = rows.groupBy("side", "lo", "hi", F.least(F.lit(n_bins - 1), F.floor((F.col(value) - F.col("lo")) / width)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy("side")) * width)).select("side", "bin", "n", "density")

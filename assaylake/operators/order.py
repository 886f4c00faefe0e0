"""Order over whole tables without a task that holds them: range partitions, places, running sums, exact quantiles.

A table is dealt into range partitions and written, so that a partition's number stays the same for all that is read from it;
totals of partitions, a row each, are all that meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaylake.session import partitions, written


def ranged(spark: SparkSession, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df written in range partitions of the order, with the partition's number as `pid`. Rows with equal keys share a partition."""
    return written(spark, df.repartitionByRange(partitions(spark), *order).withColumn("pid", F.spark_partition_id()), name)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], before: bool) -> DataFrame:
    """Add sums over all rows up to each row (before: without it), in the order that df was ranged by.

    One window for each range partition, and the partitions' totals, one row for each, joined back.
    """
    inside = W.partitionBy("pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    df = df.withColumns({f"_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    total = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy(F.col("pid").alias("_pid")).agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    parts = parts.select("_pid", *(F.coalesce(F.sum(f"__{k}").over(total), F.lit(0)).alias(f"__{k}") for k in sums))
    out = df.join(F.broadcast(parts), df["pid"] == parts["_pid"])  # a row for each partition
    return out.withColumns({k: F.col(f"_{k}") + F.col(f"__{k}") for k in sums}).drop("_pid", *(f"_{k}" for k in sums), *(f"__{k}" for k in sums))


def numbered(df: DataFrame, order: list[Column], name: str = "position", first: int = 0) -> DataFrame:
    """Rows with their place, gapless from `first`, in an order that must end in a key."""
    rows = running_sums(ranged(df.sparkSession, df, order, "numbered"), order, {name: F.lit(1).cast("bigint")}, before=True)
    return rows.withColumn(name, F.col(name) + first).drop("pid")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """For each group an array `q` of exact quantiles, interpolated; nulls do not count, and a group without a value has no row.

    Equal values are counted first, so that a value that fills half a group is one row. Only the partitions in which a
    wanted rank lies are put in order, and of these a row is kept for each rank.
    """
    spark = rows.sparkSession
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    counts = ranged(spark, counts, [*map(F.col, by), F.col("_value")], "quantiles")
    parts = counts.groupBy(*by, "pid").agg(F.sum("_n").alias("_held"))  # a row for each partition, and one more for each group
    parts = parts.withColumn("_before", F.sum("_held").over(W.partitionBy(*by).orderBy("pid")) - F.col("_held")).withColumn("_all", F.sum("_held").over(W.partitionBy(*by)))
    at = [F.lit(float(s)) * (F.col("_all") - 1) for s in shares]
    ranks = [rank for a in at for rank in (F.floor(a), F.ceil(a))]
    here = lambda rank, first, n: (rank >= first) & (rank < first + n)
    wanted = F.lit(False)
    for rank in ranks:
        wanted = wanted | here(rank, F.col("_before"), F.col("_held"))
    names = {c: f"_by_{k}" for k, c in enumerate(by)}
    parts = parts.filter(wanted).select(*(F.col(c).alias(n) for c, n in names.items()), F.col("pid").alias("_pid"), "_before", "_all")
    same = F.col("pid") == F.col("_pid")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    found = counts.join(parts, same).withColumn("_first", F.col("_before") + F.sum("_n").over(W.partitionBy(*by, "pid").orderBy("_value")) - F.col("_n"))
    ends = [F.max(F.when(here(rank, F.col("_first"), F.col("_n")), F.col("_value"))).alias(f"_r{k}") for k, rank in enumerate(ranks)]
    out = found.groupBy(*by).agg(F.max("_all").alias("_all"), *ends).filter("_all IS NOT NULL")
    q = [F.col(f"_r{2 * k}") + (F.col(f"_r{2 * k + 1}") - F.col(f"_r{2 * k}")) * (a - F.floor(a)) for k, a in enumerate(at)]
    return out.select(*by, F.array(*q).alias("q"))

"""Comparison of models over matched folds: deltas, summaries with intervals, winners, rankings, reconciliations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.operators import order


def delta_to(metrics: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """base - rmse of each model on the same fold; a fold without the baseline, or with several, is an error.

    The base is found among the rows themselves: a second evaluation of the metrics may sum doubles in another order, and the
    baseline would then differ from itself. A fold has a row for each model.
    """
    fold, own = W.partitionBy(*keys), F.when(F.col("model_id") == baseline, F.col("rmse"))
    out = metrics.withColumns({"base": F.max(own).over(fold), "_bases": F.count(own).over(fold)})
    checked = F.when(F.col("_bases") == 1, F.col("base") - F.col("rmse")).when(F.col("_bases") == 0, F.raise_error(F.lit("a fold lacks the baseline")).cast("double"))
    return out.withColumn("delta", checked.otherwise(F.raise_error(F.lit("a fold has several baselines")).cast("double"))).drop("_bases")


def summarize(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Means, sample deviations, how often better, and the normal 95 % interval of the mean delta."""
    out = deltas.groupBy(*by).agg(
        F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("sd_rmse"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd_delta"),
        F.avg((F.col("delta") > 0).cast("double")).alias("better_fraction"), F.count(F.lit(1)).alias("n_folds"),
    )
    se = F.col("sd_delta") / F.sqrt(F.col("n_folds"))
    return out.withColumns({"se": se, "ci_low": F.col("mean_delta") - 1.96 * se, "ci_high": F.col("mean_delta") + 1.96 * se, "lower_bound": F.col("mean_delta") - se})


def matched(metrics: DataFrame, model: str, other: str, keys: list[str]) -> DataFrame:
    """Two models on the same folds: gain of the first over the second."""
    side = lambda m, name: metrics.filter(F.col("model_id") == m).select(*keys, F.col("rmse").alias(name))
    return side(model, "rmse").join(side(other, "other_rmse"), keys).withColumn("gain", F.col("other_rmse") - F.col("rmse"))


def against_winner(metrics: DataFrame, winner: str, keys: list[str]) -> DataFrame:
    best = metrics.filter(F.col("model_id") == winner).select(*keys, F.col("rmse").alias("winner_rmse"))
    others = metrics.filter(F.col("model_id") != winner).join(best, keys, "left")
    return others.groupBy("model_id").agg(F.avg(F.col("rmse") - F.col("winner_rmse")).alias("mean_gain"), F.avg((F.col("winner_rmse") < F.col("rmse")).cast("double")).alias("better_fraction"), F.count(F.lit(1)).alias("n"))


def pooled_rmse(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))).alias("pooled_rmse"))


def donor_balanced_rmse(predictions: DataFrame, by: list[str], donor: str) -> DataFrame:
    """Mean error within donors, then over donors, then the root."""
    each = predictions.groupBy(*by, donor).agg(F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("e"))
    return each.groupBy(*by).agg(F.sqrt(F.avg("e")).alias("donor_rmse"), F.stddev_samp("e").alias("sd_over_donors"))


def best_of(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in a total order: by minimum of a struct, so no group is gathered or sorted."""
    rest = [c for c in df.columns if c not in by and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("r")
    return df.groupBy(*by).agg(row).select(*by, *(F.col(f"r.{c}").alias(c) for c in [*order, *rest]))


def ranking(inner: DataFrame, selected: DataFrame) -> DataFrame:
    """For each model: mean, deviation and count over inner folds, and how often it was selected; best first."""
    stats = inner.groupBy("model_id").agg(F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("sd_rmse"), F.count(F.lit(1)).alias("n"))
    picked = selected.groupBy("model_id").agg(F.count(F.lit(1)).alias("selected"))
    total = selected.agg(F.count(F.lit(1)).alias("total"))  # one row
    out = stats.join(picked, "model_id", "left").crossJoin(F.broadcast(total)).withColumn("selected", F.coalesce("selected", F.lit(0)))
    return out.withColumn("selected_fraction", F.col("selected") / F.col("total")).drop("total").orderBy("mean_rmse", "model_id")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows of either side: where they are (both, left, right) and whether the values are close."""
    left = a.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    right = b.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = left.join(right, keys, "full_outer")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return both.select(*keys, side.alias("side"), F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.lit(False)).alias("close"))


def unmatched(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids without a partner in each of two tables, zipped by position in sorted order, padded with empty strings."""
    (a, left), (b, right) = tables.items()

    def alone(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        rest = x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti")
        return order.numbered(rest, [F.col(key)], "row", 1).select(F.col(key).cast("string").alias(name), F.col("row").cast("int").alias("row"))

    return alone(left, right, a).join(alone(right, left, b), "row", "full_outer").select("row", F.coalesce(a, F.lit("")).alias(a), F.coalesce(b, F.lit("")).alias(b))


def report_order(df: DataFrame, fixed: dict[str, int], keys: list[str]) -> DataFrame:
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in fixed.items() for v in kv)), F.col("model_id")), F.lit(max(fixed.values()) + 1))
    return df.withColumn("_rank", rank).orderBy("_rank", *(F.col(k).asc_nulls_first() for k in keys)).drop("_rank")


def disjoint_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both tables by name; a key of both is an error, raised when the rows are read."""
    common = a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("common"))
    return a.unionByName(b, allowMissingColumns=True).crossJoin(F.broadcast(common)).filter(F.when(F.col("common") == 0, True).otherwise(F.raise_error(F.lit(f"{key} is in both tables")).cast("boolean"))).drop("common")

"""Training histories: best epochs, changes and convergence, moving averages, running bests, checkpoint identities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best_epoch(history: DataFrame, loss: str | None = None) -> DataFrame:
    """The epoch of the smallest finite score of each run, the earliest of equals.

    A run that has no score for some epoch with a loss is judged by its loss instead, if that is given.
    """
    if loss is not None:
        whole = history.groupBy("run").agg((F.count_if(F.col(loss).isNotNull() & F.col("score").isNull()) == 0).alias("_whole"))
        validated = history.filter(F.col(loss).isNotNull()).join(whole, "run")
        history = validated.withColumn("score", F.when(F.col("_whole"), F.col("score")).otherwise(F.col(loss)))
    ok = history.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    best = F.min(F.struct("score", "epoch"))
    return ok.groupBy("run").agg(best.alias("b")).select("run", F.col("b.epoch").alias("epoch"), F.col("b.score").alias("score"))


def convergence(history: DataFrame, window: int, tolerance: float, rate: str | None = None, floor: float = 0.0) -> DataFrame:
    """Relative change to the epoch before, and whether the last `window` changes are all within the tolerance.

    With a column of learning rates a run has converged only once its rate is down at the floor.
    """
    order = W.partitionBy("run").orderBy("epoch")
    before = F.lag("score").over(order)
    change = F.abs(F.col("score") - before) / F.greatest(F.abs(before), F.lit(1e-12))
    last = order.rowsBetween(1 - window, 0)
    rows = history.withColumn("change", change)
    stable = (F.count("change").over(last) == window) & (F.max("change").over(last) <= tolerance)
    if rate is not None:
        stable = stable & (F.col(rate) <= floor * (1 + 1e-6) + 1e-15)
    return rows.withColumn("converged", stable)


def moving_average(history: DataFrame, keep: float = 0.9) -> DataFrame:
    """Exponential moving average that starts at the first value; a run's epochs, one group, are folded in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch")
        out, held = [], None
        for score in pdf["score"]:
            held = score if held is None else keep * held + (1 - keep) * score
            out.append(held)
        return pd.DataFrame({"run": pdf["run"], "epoch": pdf["epoch"], "ema": out})

    kind = history.schema["run"].dataType.simpleString()
    return history.select("run", F.col("epoch").cast("bigint").alias("epoch"), F.col("score").cast("double").alias("score")).groupBy("run").applyInPandas(fold, f"run {kind}, epoch bigint, ema double")


#: What a score must fall by to count as better.
BETTER = 1e-12


def running_best(history: DataFrame) -> DataFrame:
    """The best score so far: one replaces the best only if it is lower by more than BETTER, so that a run is read in order.

    What may replace it is lower than all before; only these few scores of a run are folded.
    """
    before = F.min("score").over(W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1))
    lows = history.withColumn("_low", before).filter(F.col("_low").isNull() | (F.col("score") < F.col("_low")))
    lows = lows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "score"))).alias("lows"))
    kept = lows.select("run", F.explode(F.aggregate(F.slice("lows", 2, F.size("lows")), F.slice("lows", 1, 1), lambda a, x: F.when(x["score"] < F.element_at(a, -1)["score"] - BETTER, F.array_append(a, x)).otherwise(a))).alias("k"))
    best = kept.select("run", F.col("k.epoch").alias("epoch"), F.col("k.score").alias("_best"))
    held = F.last("_best", ignorenulls=True).over(W.partitionBy("run").orderBy("epoch").rowsBetween(W.unboundedPreceding, 0))
    return history.join(best, ["run", "epoch"], "left").withColumn("best", held).drop("_best")


def cadence(history: DataFrame, every: int) -> DataFrame:
    """The epochs that are validated: the first, every so many, and the last."""
    last = history.groupBy("run").agg(F.max("epoch").alias("last"))
    rows = history.join(last, "run")
    return rows.filter((F.col("epoch") == 1) | (F.col("epoch") % every == 0) | (F.col("epoch") == F.col("last"))).drop("last")


def inconsistent_scores(checkpoints: DataFrame, rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Checkpoints whose score is not half of each domain's, or not the declared best."""
    half = 0.5 * F.col("first_domain") + 0.5 * F.col("second_domain")
    off = lambda a, b: F.abs(a - b) > atol + rtol * F.abs(b)
    return checkpoints.filter(off(half, F.col("selection")) | off(F.col("selection"), F.col("declared_best")))


def weighted_clean_mse(rows: DataFrame) -> DataFrame:
    """rows(domain, donor, sse, sum_y, sum_y2, n): each biopsy weighs 1 / biopsies of its donor: mse, r2, deviation over donors."""
    count = rows.groupBy("domain", "donor").agg(F.count(F.lit(1)).alias("k"))
    w = rows.join(count, ["domain", "donor"]).withColumn("w", 1.0 / F.col("k"))
    totals = w.groupBy("domain").agg(F.sum(F.col("w") * F.col("sse")).alias("sse"), F.sum(F.col("w") * F.col("sum_y")).alias("sy"), F.sum(F.col("w") * F.col("sum_y2")).alias("sy2"), F.sum(F.col("w") * F.col("n")).alias("n"))
    donors = rows.groupBy("domain", "donor").agg(F.avg(F.col("sse") / F.col("n")).alias("m")).groupBy("domain").agg(F.stddev_samp("m").alias("sd_over_donors"))
    return totals.join(donors, "domain").select("domain", (F.col("sse") / F.col("n")).alias("mse"), (1 - F.col("sse") / (F.col("sy2") - F.col("sy") * F.col("sy") / F.col("n"))).alias("r2"), "sd_over_donors")

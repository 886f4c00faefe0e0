"""Evaluation designs: models over folds of donors, every feature fitted on the training patients of its fold alone.

A design is joins and aggregates: folds with the blocks of features that patients have, the parameters of each fold and block, found on
training rows, with all rows, and the catalogue of models with the blocks each takes. Nothing is fitted in a loop over folds.

- folds: stage, repeat, fold, inner_fold (-1 outside inner folds), patient, donor, is_train
- features: block, patient, x; the same for all folds. Scores fitted in a fold have the fold's columns too.
- catalogue: Model, the same for all folds of a stage; `main` features have one effect, `timed` ones one at each time
- outcomes: patient, time_ord, egfr
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions import ids
from assaylake.operators import models, order, reports, sums
from assaylake.operators.normalize import FOLD_FLAT
from assaylake.operators.splits import _ranked, hashed_order, part_of
from assaylake.session import written

FIXED, INNER, OUTER = "fixed_evaluation", "inner_selection", "outer_evaluation"
FOLD = ["stage", "repeat", "fold", "inner_fold"]


@dataclass(frozen=True)
class Model:
    stage: str
    model_id: str
    label: str
    candidate_id: str = ""
    main: str | None = None
    timed: str | None = None
    description: str = ""


CATALOGUE = "stage string, model_id string, label string, candidate_id string, main string, timed string, description string"


# --- catalogues


def _models(stage: str, encoders: dict[str, str], components: dict[str, str], singles: dict[str, str], key: str | None, full: str | None, standalone: bool) -> list[Model]:
    out = [Model(stage, "time_only", "Time only")] if standalone else []
    out += [Model(stage, e, label, e, e, None, f"{e} latent components") for e, label in encoders.items()]
    out += [Model(stage, p, label, "", p, None, "principal components of the fold") for p, label in components.items()]
    if full is None:
        return out
    if standalone:
        out += [Model(stage, s, f"{label} x time", "", None, s, s) for s, label in singles.items()]
        out.append(Model(stage, full, f"{' + '.join(singles.values())} x time", "", None, full, " + ".join(singles)))
    for blocks, own in ((encoders, True), (components, False)):
        for b, label in blocks.items():
            out.append(Model(stage, f"{b}_kdri", f"{label} + {singles[key]} x time", b if own else "", b, key, f"{b} + {key}"))
            out.append(Model(stage, f"{b}_clinical", f"{label} + full clinical x time", b if own else "", b, full, f"{b} + {' + '.join(singles)}"))
    return out


def fixed_catalogue(encoders: dict[str, str], components: dict[str, str] | None = None, singles: dict[str, str] | None = None, key: str | None = None, full: str | None = "clinical_full", standalone: bool = True) -> list[Model]:
    """Time alone, encoders, components, clinical variables one by one and all, and encoders and components with the key one and with all.

    The dicts name blocks and give labels; without `singles` there are no clinical models.
    """
    return _models(FIXED, encoders, components or {}, singles or {}, key, full if singles else None, standalone)


def nested_catalogue(encoders: dict[str, str], components: dict[str, str] | None = None, singles: dict[str, str] | None = None, key: str | None = None, full: str | None = "clinical_full") -> list[Model]:
    """Encoders in the inner folds, among which a candidate is selected; all models in the outer ones."""
    inner = [Model(INNER, e, label, e, e, None, f"{e} latent components") for e, label in encoders.items()]
    return inner + _models(OUTER, encoders, components or {}, singles or {}, key, full if singles else None, True)


# --- folds


def _parted(donors: DataFrame, by: list[str], parts: int, seed: Column) -> DataFrame:
    """donors(*by, donor) with the part, from 0, of each in its group's pseudo-random order; a group of fewer than `parts` is an error."""
    n = donors.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = _ranked(donors, by, seed, hashed_order(seed)).join(F.broadcast(n), by)  # a row for each fold
    few = F.raise_error(F.lit("there are fewer donors than folds")).cast("int")
    return rows.select(*by, "donor", F.when(F.col("_n") >= parts, part_of(F.col("rank"), F.col("_n"), parts)).otherwise(few).alias("part"))


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _refused(n_splits: int, n_repeats: int) -> None:
    if n_splits < 2 or n_repeats < 1:
        raise ValueError("folds must be at least two, repeats at least one")


def fixed_folds(patients: DataFrame, n_splits: int, n_repeats: int, seed: int, stage: str = FIXED) -> DataFrame:
    """Folds of patients(patient, donor), n_splits in each repeat: a donor's patients are tested in one of them and train in the others."""
    _refused(n_splits, n_repeats)
    donors = patients.select("donor").distinct().withColumn("repeat", _numbers(n_repeats))
    parts = _parted(donors, ["repeat"], n_splits, F.lit(seed) + F.col("repeat"))
    rows = patients.select("patient", "donor").join(parts, "donor").withColumn("fold", _numbers(n_splits))
    return rows.select(F.lit(stage).alias("stage"), "repeat", "fold", F.lit(-1).alias("inner_fold"), "patient", "donor", (F.col("part") != F.col("fold")).alias("is_train"))


def nested_folds(patients: DataFrame, n_splits: int, n_repeats: int, inner_splits: int, seed: int) -> DataFrame:
    """Outer folds, and within the training patients of each, inner ones by donors of their own pseudo-random order."""
    _refused(inner_splits, n_repeats)
    outer = fixed_folds(patients, n_splits, n_repeats, seed, OUTER)
    train = outer.filter("is_train")
    parts = _parted(train.select("repeat", "fold", "donor").distinct(), ["repeat", "fold"], inner_splits, F.lit(seed + 10_000) + F.col("repeat") * 101 + F.col("fold"))
    inner = train.join(parts, ["repeat", "fold", "donor"]).withColumn("inner_fold", _numbers(inner_splits))
    inner = inner.select(F.lit(INNER).alias("stage"), "repeat", "fold", "inner_fold", "patient", "donor", (F.col("part") != F.col("inner_fold")).alias("is_train"))
    return outer.unionByName(inner)


# --- features


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def scaled(folds: DataFrame, features: DataFrame, of_folds: DataFrame | None = None) -> DataFrame:
    """For each fold, block and patient x, imputed by the training median, less the training mean, over the training deviation.

    Blocks without a missing value are never taken apart. A feature without a training value in a fold is an error.
    """
    spark = folds.sparkSession
    features = features.withColumn("x", F.transform("x", lambda v: v.cast("double")))
    rows = folds.select(*FOLD, "patient", "is_train").join(features, "patient")
    with_missing = [r["block"] for r in features.filter(F.exists("x", _missing)).select("block").distinct().collect()]  # a row for each block
    rows = rows.select(*FOLD, "block", "patient", "is_train", "x")
    if with_missing:
        some = F.col("block").isin(with_missing)
        cells = rows.filter(some & F.col("is_train")).select(*FOLD, "block", F.posexplode("x").alias("pos", "v")).withColumn("v", F.when(~_missing(F.col("v")), F.col("v")))
        medians = order.quantiles(cells, [*FOLD, "block", "pos"], "v", (0.5,))
        medians = medians.groupBy(*FOLD, "block").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.get("q", F.lit(0)).alias("m")))).alias("_m"))  # as long as a vector
        empty = F.raise_error(F.lit("a feature has no training value in a fold")).cast("double")
        filled = F.transform("x", lambda v, k: F.when(~_missing(v), v).otherwise(F.coalesce(F.try_element_at("_m", k), empty)))
        rows = rows.filter(~some).unionByName(rows.filter(some).join(medians, [*FOLD, "block"], "left").withColumn("x", filled).drop("_m"))
    if of_folds is not None:
        rows = rows.unionByName(folds.select(*FOLD, "patient", "is_train").join(of_folds, [*FOLD, "patient"]).select(rows.columns))
    rows = written(spark, rows, "design-features")
    found = sums.moments(rows.filter("is_train"), [*FOLD, "block"], "x").select(*FOLD, "block", "mean", F.transform("sd", lambda s: F.when(s > FOLD_FLAT, s).otherwise(1.0)).alias("sd"))
    off = F.zip_with(F.zip_with("x", "mean", lambda x, m: x - m), "sd", lambda d, s: d / s)
    return rows.join(found, [*FOLD, "block"]).select(*FOLD, "block", "patient", off.alias("x"))


def component_blocks(folds: DataFrame, matrix: DataFrame, sizes: Iterable[int], name: str = "pca_d{}", **more) -> DataFrame:
    """Blocks of scores on each fold's components of matrix(patient, x), one for each size; smaller ones are the first of the largest."""
    sizes = sorted(set(sizes))
    if not sizes or sizes[0] < 1:
        raise ValueError("components must be at least one")
    rows = folds.select(*FOLD, "patient", "is_train").join(matrix, "patient").withColumnRenamed("patient", "id")
    scores = models.pca(rows, sizes[-1], FOLD, **more)
    each = F.explode(F.array(*(F.struct(F.lit(name.format(k)).alias("block"), F.slice("scores", 1, k).alias("x")) for k in sizes)))
    return scores.select(*FOLD, F.col("id").alias("patient"), each.alias("b")).select(*FOLD, "b.block", "patient", "b.x")


# --- designs


def _fit_id() -> Column:
    text = lambda c: F.col(c).cast("string")
    outer = F.concat(F.lit("outer_r"), text("repeat"), F.lit("_f"), text("fold"), F.lit("_"), F.col("model_id"))
    inner = F.concat(F.lit("inner_r"), text("repeat"), F.lit("_f"), text("fold"), F.lit("_i"), text("inner_fold"), F.lit("_"), F.col("model_id"))
    return F.when(F.col("stage") == FIXED, ids.fit_id(F.col("repeat"), F.col("fold"), F.col("model_id"))).when(F.col("stage") == INNER, inner).otherwise(outer)


def _catalogue(df: DataFrame, catalogue: list[Model]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([astuple(m) for m in catalogue], CATALOGUE))  # the caller's list


def specifications(folds: DataFrame, features: DataFrame, catalogue: list[Model]) -> DataFrame:
    """One row for each fit: its names, fold and numbers of features, of scaled features; a fit that is there twice is an error."""
    sizes = features.groupBy(*FOLD, "block").agg(F.max(F.size("x")).alias("n"))
    rows = folds.select(*FOLD).distinct().join(_catalogue(folds, catalogue), "stage")
    for kind in ("main", "timed"):
        own = sizes.select(*FOLD, F.col("block").alias(kind), F.col("n").alias(f"n_{kind}"))
        rows = rows.join(own, [*FOLD, kind], "left").withColumn(f"n_{kind}", F.when(F.col(kind).isNull(), 0).otherwise(F.coalesce(f"n_{kind}", F.raise_error(F.lit("a block is in no fold")).cast("int"))))
    rows = rows.withColumn("fit_id", _fit_id()).withColumn("n_features", F.col("n_main") + F.col("n_timed"))
    twice = rows.groupBy("fit_id").agg(F.count(F.lit(1)).alias("_n"))
    fit = F.when(F.col("_n") == 1, F.col("fit_id")).otherwise(F.raise_error(F.lit("a fit is there twice")).cast("string"))
    return rows.join(twice, "fit_id").withColumn("fit_id", fit).drop("_n")


def design(folds: DataFrame, features: DataFrame, catalogue: list[Model], outcomes: DataFrame) -> DataFrame:
    """One row for each fit, patient and time: fit_id, its names and fold, is_train, patient, donor, time_ord, egfr, main, x (timed).

    A block that a patient of a fold lacks, or has twice, is an error.
    """
    held = features.groupBy(*FOLD, "patient").agg(F.map_from_entries(F.collect_list(F.struct("block", "x"))).alias("_x"))  # a row's blocks
    rows = folds.join(held, [*FOLD, "patient"], "left").join(_catalogue(folds, catalogue), "stage")

    def block(kind: str) -> Column:
        lacks = F.raise_error(F.concat(F.lit("a patient lacks "), F.col(kind))).cast("array<double>")
        return F.when(F.col(kind).isNull(), F.array().cast("array<double>")).otherwise(F.coalesce(F.try_element_at("_x", F.col(kind)), lacks))

    rows = rows.select(_fit_id().alias("fit_id"), *FOLD, "model_id", "candidate_id", "is_train", "patient", "donor", block("main").alias("main"), block("timed").alias("x"))
    return rows.join(outcomes.select("patient", "time_ord", "egfr"), "patient")


def evaluated(rows: DataFrame) -> DataFrame:
    """Every fit of a design: its names and fold, ratio, rmse, mae, singular, n_train."""
    names = rows.select("fit_id", *FOLD, "model_id", "candidate_id").distinct()
    return names.join(models.fit_mixed_models(rows.select("fit_id", "is_train", "patient", "time_ord", "egfr", "main", "x")), "fit_id")


def selected(fits: DataFrame) -> DataFrame:
    """For each outer fold the candidate of the least mean error over its inner folds, and its outer error: repeat, fold, candidate_id, inner_rmse, n_inner, rmse, mae."""
    inner = fits.filter(F.col("stage") == INNER).groupBy("repeat", "fold", "candidate_id").agg(F.avg("rmse").alias("inner_rmse"), F.count(F.lit(1)).alias("n_inner"))
    best = reports.best_of(inner, ["repeat", "fold"], ["inner_rmse", "candidate_id"])
    outer = fits.filter((F.col("stage") == OUTER) & (F.col("model_id") == F.col("candidate_id"))).select("repeat", "fold", "candidate_id", "rmse", "mae")
    return best.join(outer, ["repeat", "fold", "candidate_id"])

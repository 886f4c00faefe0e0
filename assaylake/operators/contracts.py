"""Fail-closed checks: each returns the rows that break it, and enforce() raises with the first five."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.functions import ids, vectors
from assaylake.operators import sums


class ContractError(ValueError):
    pass


def enforce(violations: DataFrame, what: str) -> None:
    if found := [r.asDict() for r in violations.limit(5).collect()]:
        raise ContractError(f"{what}: {found}")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_permutation(df: DataFrame, order: str) -> DataFrame:
    """One row if the column is not 0 .. n-1, each once."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(order).alias("d"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    return s.filter("n > 0 AND (d <> n OR lo <> 0 OR hi <> n - 1)")


def wrong_shape(df: DataFrame, n_columns: int, values: str = "values") -> DataFrame:
    return df.filter(F.size(values) != n_columns)


def not_finite(df: DataFrame, key: str, values: str = "values") -> DataFrame:
    return df.filter(~vectors.all_finite(values)).select(key)


def wrong_labels(df: DataFrame, column: str, allowed: set[str], all_of_them: bool) -> DataFrame:
    """Labels that are not allowed, and allowed ones that are missing if all must occur."""
    have = df.select(F.col(column).alias("label")).distinct()
    want = df.sparkSession.createDataFrame([(x,) for x in sorted(allowed)], "label string")
    extra = have.join(want, "label", "left_anti").withColumn("problem", F.lit("not allowed"))
    lacking = want.join(have, "label", "left_anti").withColumn("problem", F.lit("missing"))
    return extra.unionByName(lacking) if all_of_them else extra


def crossing(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups in more than one part: leaks."""
    return df.groupBy(group).agg(F.countDistinct(part).alias("parts")).filter("parts > 1")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table alone, counted as often as they occur."""
    return a.exceptAll(b.select(a.columns)).withColumn("side", F.lit("first")).unionByName(b.select(a.columns).exceptAll(a).withColumn("side", F.lit("second")))


def not_contiguous(ranges: DataFrame, total: int) -> DataFrame:
    """Ranges(start, stop, n) that do not follow one another from 0 to the total. One row a group, so one window over them is small."""
    order = W.orderBy("start")
    checked = ranges.withColumns({"next": F.lead("start").over(order), "first": F.row_number().over(order) == 1})
    return checked.filter((F.col("first") & (F.col("start") != 0)) | (F.coalesce("next", F.lit(total)) != F.col("stop")) | (F.col("stop") - F.col("start") != F.col("n"))).drop("next", "first")


def nested_leaks(manifest: DataFrame) -> DataFrame:
    """Donors of a nested manifest with two roles in a fold, or test donors with an inner role."""
    roles = manifest.groupBy("repeat", "fold", "donor").agg(F.countDistinct("outer_role", "inner_role").alias("roles"), F.count_if((F.col("outer_role") == "outer_test") & (F.col("inner_role") != "not_applicable")).alias("bad"))
    return roles.filter("roles > 1 OR bad > 0")


def incomplete(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected)


def unknown_namespace(df: DataFrame, key: str, namespaces: set[str]) -> DataFrame:
    return df.filter(~F.split_part(key, F.lit(":"), F.lit(1)).isin(*namespaces))


def required_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"columns are missing: {missing}")


def assert_contract(found: dict, wanted: dict) -> None:
    """A provenance document must say what is wanted, field by field."""
    if off := {k: (found.get(k), v) for k, v in wanted.items() if found.get(k) != v}:
        raise ContractError(f"the contract differs (found, wanted): {json.dumps(off, default=str)}")


def canonical_counts(found: dict[str, int], total: int, wanted: dict[str, int]) -> None:
    """Counts must be the wanted ones, but only for the cohort that has the canonical total."""
    if sum(found.values()) == total and found != wanted:
        raise ContractError(f"the canonical cohort has {found} instead of {wanted}")


def role_faults(manifest: DataFrame) -> DataFrame:
    """Rows of manifest(sample_id, donor, role, split) that contradict one another: a donor other than the id's, a held-out sample in
    training or validation, a donor in more than one split."""
    donor = ids.donor_of_biopsy(F.col("sample_id"))
    own = manifest.withColumn("problem", F.when(F.upper("donor") != donor, "donor").when((F.col("role") != "eligible") & F.col("split").isNotNull(), "role"))
    parts = crossing(manifest.filter("split IS NOT NULL"), "donor", "split").select("donor")
    return own.filter("problem IS NOT NULL").unionByName(manifest.join(parts, "donor", "left_semi").select(*manifest.columns).withColumn("problem", F.lit("split")))


def not_fitted_on(rows: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """Ids a reference was fitted on that are not the training ids, and training ids it was not fitted on."""
    return differing(rows.filter("split = 'train'").select(key).distinct(), fitted.select(key).distinct())


def saved_split_faults(saved: DataFrame, wanted: DataFrame, key: str = "sample", group: str = "component") -> DataFrame:
    """What is wrong with saved(key, group, split): ids other than wanted, repeated ids, unknown labels, groups in more than one part."""
    name = lambda df, problem: df.select(F.col(df.columns[0]).cast("string").alias("id"), F.lit(problem).alias("problem"))
    faults = name(wanted.select(key).join(saved, key, "left_anti"), "missing")
    faults = faults.unionByName(name(saved.select(key).join(wanted, key, "left_anti"), "unknown id"))
    faults = faults.unionByName(name(repeated(saved, [key]), "repeated"))
    faults = faults.unionByName(name(saved.filter(~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))).select(key), "label"))
    return faults.unionByName(name(crossing(saved, group, "split"), "crosses parts"))


def not_same_order(a: DataFrame, b: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Places at which two ordered lists have different ids, or only one has any."""
    x, y = a.select(F.col(order).alias("at"), F.col(key).alias("first")), b.select(F.col(order).alias("at"), F.col(key).alias("second"))
    return x.join(y, "at", "full_outer").filter(~F.col("first").eqNullSafe(F.col("second")))


#: Settings of a training run: least and greatest value, and which of the two is itself left out. Fixed values.
SETTINGS = (
    ("input_dim", 1, None, ""), ("latent_dim", 1, None, ""), ("low_rank_dim", 1, None, ""), ("residual_blocks", 0, 8, ""), ("residual_expansion", 1, 8, ""),
    ("dropout", 0, 1, "high"), ("weight_decay", 0, None, ""), ("l2_lambda", 0, None, ""), ("epochs", 1, None, ""), ("batch_size", 1, None, ""),
    ("learning_rate", 0, None, "low"), ("lr_decay_epochs", 1, None, ""), ("convergence_tolerance", 0, None, ""), ("convergence_window", 1, None, ""),
    ("early_stopping_patience", 0, None, ""), ("lr_patience", 1, None, ""), ("lr_factor", 0, 1, "both"), ("gradient_clip", 0, None, ""),
    ("validation_every_epochs", 1, None, ""), ("validation_geo_weight", 0, 1, "both"), ("ui_update_batches", 1, None, ""),
    ("latent_pca_every_epochs", 1, None, ""), ("latent_pca_max_samples", 2, None, ""), ("huber_delta", 0, None, "low"), ("cosine_weight", 0, None, ""),
    ("kl_beta", 0, None, ""), ("kl_warmup_epochs", 0, None, ""), ("mmd_weight", 0, None, ""), ("mask_fraction", 0, 1, "both"), ("softmax_temperature", 0, None, "low"),
)


def setting_faults(runs: DataFrame, key: str, choices: dict[str, set[str]] | None = None) -> DataFrame:
    """key, setting, value of each setting of runs that is missing, out of its range or not among its choices.

    A setting that is no column is not looked at; hidden_widths, if there, must hold positive widths.
    """
    found = []
    for name, low, high, out in SETTINGS:
        if name in runs.columns:
            v = F.col(name).cast("double")
            good = (v > low if out in ("low", "both") else v >= low) & (F.lit(True) if high is None else v < high if out in ("high", "both") else v <= high) & ~F.isnan(v)
            found.append((name, good))
    found += [(name, F.col(name).isin(*sorted(allowed))) for name, allowed in (choices or {}).items() if name in runs.columns]
    if "hidden_widths" in runs.columns:
        found.append(("hidden_widths", (F.size("hidden_widths") > 0) & F.forall("hidden_widths", lambda w: w >= 1)))
    rows = F.array(*(F.struct(F.lit(n).alias("setting"), F.col(n).cast("string").alias("value"), F.coalesce(good, F.lit(False)).alias("good")) for n, good in found))
    return runs.select(key, F.explode(rows).alias("s")).filter("NOT s.good").select(key, "s.setting", "s.value")


def out_of_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Settings outside their closed ranges, or missing: a row for each."""
    found = F.array(*(F.struct(F.lit(c).alias("setting"), F.col(c).cast("double").alias("value"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")) for c, (lo, hi) in ranges.items()))
    keys = [c for c in df.columns if c not in ranges]
    return df.select(*keys, F.explode(found).alias("s")).select(*keys, "s.*").filter("value IS NULL OR value < low OR value > high")


def unfit_matrix(rows: DataFrame, train: str, values: str = "values") -> DataFrame:
    """Features that training cannot use: missing or not finite somewhere, or of one value in all training rows.

    n_values counts the distinct values of a feature in training rows: not a number is one, missing is none.
    """
    rows = rows.select(F.coalesce(train, F.lit(False)).alias("_train"), F.col(values).alias("_values"))
    found = sums.moments(rows, ["_train"], "_values")
    each = found.select("_train", F.posexplode(F.arrays_zip("low", "high", "n_not_finite")).alias("pos", "s"))
    each = each.groupBy("pos").agg(F.sum("s.n_not_finite").alias("n_not_finite"), F.coalesce(F.max(F.when(F.col("_train"), F.col("s.low") != F.col("s.high"))), F.lit(False)).alias("varies"))
    unfit = sums.kept(each.filter("n_not_finite > 0 OR NOT varies"), "unfit-features")  # a row for each such feature
    cells = rows.filter("_train").select(F.posexplode("_values").alias("pos", "value")).join(F.broadcast(unfit.select("pos")), "pos", "left_semi")
    counted = cells.distinct().groupBy("pos").agg(F.count("value").alias("n_values"))  # values meet in tasks by value: none holds all of a feature
    return unfit.join(counted, "pos", "left").select("pos", "n_not_finite", F.coalesce("n_values", F.lit(0)).cast("bigint").alias("n_values"), "varies")


def not_identical(a: DataFrame, b: DataFrame, keys: list[str], score: str = "score", relative: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """Checkpoints of two lists that are not the same file: other size, time or score, or in one list alone."""
    both = a.alias("a").join(b.alias("b"), keys, "full_outer")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime") == F.col("b.mtime")) & (F.abs(F.col(f"a.{score}") - F.col(f"b.{score}")) <= absolute + relative * F.abs(F.col(f"b.{score}")))
    return both.filter(~F.coalesce(same, F.lit(False))).select(*keys)


def expected_counts(df: DataFrame, wanted: dict[str, int]) -> None:
    """Distinct values of each named column must be as many as wanted."""
    found = df.agg(*(F.countDistinct(c).alias(c) for c in wanted)).first().asDict()
    assert_contract(found, wanted)

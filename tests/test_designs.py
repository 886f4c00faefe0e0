"""Evaluation designs: folds by donors, features fitted on training rows alone, unique fits, refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import designs


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{k}", f"d{k // 2}", [float(v) for v in rng.normal(size=6)], [float(rng.integers(20, 70)), float(rng.normal()), None if k % 5 == 0 else float(rng.normal())]) for k in range(30)]
    patients = spark.createDataFrame([(p, d) for p, d, *_ in rows], "patient string, donor string")
    features = spark.createDataFrame([(b, p, v) for p, _, x, c in rows for b, v in (("z", x[:2]), ("clinical_full", c), ("age", c[:1]), ("kdri", c[1:2]), ("cold", c[2:]))], "block string, patient string, x array<double>")
    matrix = spark.createDataFrame([(p, x) for p, _, x, _ in rows], "patient string, x array<double>")
    outcomes = spark.createDataFrame([(p, t, float(40 + t + x[0] + rng.normal())) for p, _, x, _ in rows for t in range(4)], "patient string, time_ord int, egfr double")
    return patients, features, matrix, outcomes


SINGLES = {"age": "Age", "kdri": "KDRI", "cold": "Ischemia"}


def test_a_fixed_design_has_fold_local_features(cohort):
    patients, features, matrix, outcomes = cohort
    folds = designs.fixed_folds(patients, 5, 2, 3)
    scaled = designs.scaled(folds, features, designs.component_blocks(folds, matrix, [2], "pca"))
    catalogue = designs.fixed_catalogue({"z": "Winner"}, {"pca": "PCA"}, SINGLES, "kdri")
    names = {"time_only", "z", "pca", "age", "kdri", "cold", "clinical_full", "z_kdri", "z_clinical", "pca_kdri", "pca_clinical"}
    specs = designs.specifications(folds, scaled, catalogue).toPandas()
    assert set(specs.model_id) == names and len(specs) == 110 and specs.fit_id.is_unique
    full = specs[specs.model_id == "z_clinical"].iloc[0]
    assert (full.n_main, full.n_timed, full.n_features) == (2, 3, 5)
    rows = designs.design(folds, scaled, catalogue, outcomes).toPandas()
    assert len(rows) == 110 * 30 * 4
    for (_, _, model), own in rows[rows.time_ord == 0].groupby(["repeat", "fold", "model_id"]):
        train = own[own.is_train]
        assert set(train.donor).isdisjoint(own[~own.is_train].donor)
        for column in ("main", "x"):
            x = np.stack(train[column])
            assert np.isfinite(x).all() and np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1, atol=1e-9), model
    tested = rows[(rows.model_id == "time_only") & ~rows.is_train].groupby("repeat").patient.apply(lambda x: sorted(set(x)))
    assert all(len(x) == 30 for x in tested)


def test_without_clinical_variables_and_baselines():
    assert {m.model_id for m in designs.fixed_catalogue({"z": "Z"}, {"pca": "PCA"})} == {"time_only", "z", "pca"}
    assert {m.model_id for m in designs.fixed_catalogue({"z": "Z"}, singles=SINGLES, key="kdri", standalone=False)} == {"z", "z_kdri", "z_clinical"}


def test_held_out_rows_do_not_move_a_fit(spark, cohort):
    patients, features, matrix, outcomes = cohort
    folds = spark.createDataFrame(designs.fixed_folds(patients, 3, 1, 3).filter("fold = 0").collect())
    held = {r.patient for r in folds.filter("NOT is_train").collect()}
    out = F.col("patient").isin(list(held))
    moved = lambda df: df.withColumn("x", F.when(out, F.transform("x", lambda v: v * 9 + 100)).otherwise(F.col("x")))
    catalogue = designs.fixed_catalogue({"z": "Z"}, {"pca": "PCA"}, SINGLES, "kdri")

    def trained(features, matrix, outcomes):
        rows = designs.design(folds, designs.scaled(folds, features, designs.component_blocks(folds, matrix, [2], "pca")), catalogue, outcomes)
        fits = {r.fit_id: r.ratio for r in designs.evaluated(rows).collect()}
        return sorted((r.fit_id, r.patient, r.time_ord, np.round([*r.main, *r.x], 9).tolist()) for r in rows.filter("is_train").collect()), fits

    a, fits = trained(features, matrix, outcomes)
    b, others = trained(moved(features), moved(matrix), outcomes.withColumn("egfr", F.when(out, F.col("egfr") + 1000).otherwise(F.col("egfr"))))
    assert a == b and fits == pytest.approx(others, rel=1e-3)  # the deviance is flat at its least


def test_a_nested_design_selects_within_outer_training_folds(cohort):
    patients, features, _, outcomes = cohort
    features = features.unionByName(features.filter("block = 'z'").select(F.lit("y").alias("block"), "patient", F.transform("x", lambda v: v * v).alias("x")))
    folds = designs.nested_folds(patients, 3, 2, 2, 7)
    every = folds.toPandas()
    for (repeat, fold), outer in every[every.stage == designs.OUTER].groupby(["repeat", "fold"]):
        train = set(outer[outer.is_train].donor)
        inner = every[(every.stage == designs.INNER) & (every["repeat"] == repeat) & (every.fold == fold)]
        assert set(inner.donor) == train and set(outer[~outer.is_train].donor).isdisjoint(train)
        tests = [set(x[~x.is_train].donor) for _, x in inner.groupby("inner_fold")]
        assert len(tests) == 2 and set.union(*tests) == train and not tests[0] & tests[1] and abs(len(tests[0]) - len(tests[1])) <= 1
    scaled = designs.scaled(folds, features)
    catalogue = designs.nested_catalogue({"z": "Z", "y": "Y"}, singles=SINGLES, key="kdri")
    specs = designs.specifications(folds, scaled, catalogue).toPandas()
    assert specs.fit_id.is_unique and (specs.stage == designs.INNER).sum() == 2 * 3 * 2 * 2 and (specs.stage == designs.OUTER).sum() == 2 * 3 * 11
    fits = designs.evaluated(designs.design(folds, scaled, catalogue, outcomes))
    kept = fits.toPandas()
    got = {(r.repeat, r.fold): r for r in designs.selected(fits).collect()}
    assert len(got) == 6
    for (repeat, fold), r in got.items():
        inner = kept[(kept.stage == designs.INNER) & (kept["repeat"] == repeat) & (kept.fold == fold)].groupby("candidate_id").rmse.mean()
        assert r.candidate_id == inner.idxmin() and r.inner_rmse == pytest.approx(inner.min()) and r.n_inner == 2
        assert r.rmse == pytest.approx(kept[(kept.stage == designs.OUTER) & (kept["repeat"] == repeat) & (kept.fold == fold) & (kept.model_id == r.candidate_id)].rmse.iloc[0])


def test_designs_are_refused(spark, cohort):
    patients, features, _, outcomes = cohort
    folds = designs.fixed_folds(patients, 3, 1, 3)
    some = features.filter("NOT (block = 'z' AND patient = 'p3')")
    with pytest.raises(Exception, match="lacks z"):
        designs.design(folds, designs.scaled(folds, some), designs.fixed_catalogue({"z": "Z"}), outcomes).collect()
    with pytest.raises(Exception, match="(?i)duplicate"):
        designs.design(folds, designs.scaled(folds, features.unionByName(features.filter("block = 'z' AND patient = 'p3'"))), designs.fixed_catalogue({"z": "Z"}), outcomes).collect()
    with pytest.raises(Exception, match="no training value"):
        designs.scaled(folds, features.withColumn("x", F.when(F.col("block") == "cold", F.array(F.lit(None).cast("double"))).otherwise(F.col("x")))).collect()
    with pytest.raises(Exception, match="fewer donors"):
        designs.fixed_folds(patients.limit(2), 5, 1, 3).collect()
    with pytest.raises(ValueError, match="two"):
        designs.fixed_folds(patients, 1, 1, 3)
    with pytest.raises(Exception, match="twice"):
        designs.specifications(folds, designs.scaled(folds, features), designs.fixed_catalogue({"z": "Z"}) * 2).collect()

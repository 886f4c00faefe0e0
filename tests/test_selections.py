"""Selections and contracts that raise, files that are whole, formulas against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import ids, training
from assaylake.operators import contracts, history, models, normalize, selections, splits, store
from assaylake.operators.contracts import ContractError
from assaylake.sources import sinks


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def test_joins_that_would_repeat_or_lose_rows_fail(spark):
    a, b = frame(spark, [(1, 2.0), (2, 3.0)], "k int, v double"), frame(spark, [(1, 5.0), (1, 6.0)], "k int, w double")
    with pytest.raises(ContractError, match="right side"):
        selections.joined_one_to_one(a, b, ["k"])
    with pytest.raises(ContractError, match="instead of 25"):
        selections.paired(a, a, ["k"], ["v"], ("x", "y"), 25)
    with pytest.raises(Exception, match="not there"):
        selections.gather(frame(spark, [(7, 0)], "id int, ord bigint"), frame(spark, [(3, 0)], "at bigint, ord bigint")).collect()
    with pytest.raises(ContractError, match="no column"):
        selections.dataset_labels(frame(spark, [(None,)], "GSE string"))
    with pytest.raises(ContractError, match="only 0 ids"):
        selections.in_all(frame(spark, [("m", 1), ("n", 2)], "method string, id int"), "method", "id")
    with pytest.raises(ContractError, match="comparison ids"):
        selections.comparison({"p": a.unionByName(a)}, ["k"])
    with pytest.raises(ContractError, match="lack metrics"):
        selections.assembled(frame(spark, [(1, 1, "a")], "repeat int, fold int, model_id string"), frame(spark, [(1, 2, "a")], "repeat int, fold int, model_id string"), [])


def test_counts_of_the_canonical_cohort_alone_are_checked():
    contracts.canonical_counts({"train": 5}, 7, {"train": 1})
    with pytest.raises(ContractError):
        contracts.canonical_counts({"train": 5, "test": 2}, 7, {"train": 4, "test": 3})


def test_expected_counts(spark):
    rows = frame(spark, [(1, "a"), (2, "a")], "biopsy int, donor string")
    contracts.expected_counts(rows, {"biopsy": 2, "donor": 1})
    with pytest.raises(ContractError):
        contracts.expected_counts(rows, {"donor": 2})


def test_files_are_whole_kept_and_immutable(tmp_path):
    path = tmp_path / "a" / "x.csv"
    sinks.write_csv(path, ["k", "v"], [(1, "a"), (2, "b,c")])
    assert path.read_text() == 'k,v\n1,a\n2,"b,c"\n' and [p.name for p in path.parent.iterdir()] == ["x.csv"]
    sinks.append_csv(path, ["k", "v"], [(3, "d")])
    assert path.read_text().count("k,v") == 1 and path.read_text().endswith("3,d\n")
    with pytest.raises(ContractError):
        sinks.append_csv(path, ["k"], [(3,)])
    kept = sinks.install(path, b"new")
    assert kept.read_text().startswith("k,v") and path.read_bytes() == b"new" and sinks.install(tmp_path / "none", b"") is None
    first = sinks.keep_manifest(tmp_path / "m.csv", ["d", "f"], [("b", 2), ("a", 1)])
    assert first == sinks.keep_manifest(tmp_path / "m.csv", ["d", "f"], [("a", 1), ("b", 2)])
    with pytest.raises(ContractError, match="immutable"):
        sinks.keep_manifest(tmp_path / "m.csv", ["d", "f"], [("a", 2), ("b", 2)])
    assert sinks.write_split(tmp_path, "geo", 7, ["s"], [("x",)]).name == "geo_seed7.csv"
    sinks.write_npz(tmp_path / "z.npz", x=np.arange(3))
    assert np.load(tmp_path / "z.npz")["x"].tolist() == [0, 1, 2]


def test_hashes_depend_on_content_alone(tmp_path):
    assert sinks.contract_hash({"a": 1, "b": [2]}) == sinks.contract_hash({"b": [2], "a": 1}) != sinks.contract_hash({"a": 1, "b": [3]})
    x = np.arange(6, dtype="<f4").reshape(2, 3)
    assert sinks.array_hash(x) == sinks.array_hash(x.astype(">f4")) == sinks.array_hash(np.asfortranarray(x)) != sinks.array_hash(x.reshape(3, 2))
    (tmp_path / "f").write_bytes(b"abc")
    assert sinks.file_hash(tmp_path / "f", 2) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_latent_divergence_and_penalty():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(40, 3))
    plain = []
    for s in training.SCALES:
        c = 6 * s
        k = lambda a, b: c / (c + ((a - b) ** 2).sum() + 1e-8)  # noqa: B023, E731
        within = [np.mean([k(z[i], z[j]) for i in range(40) for j in range(40) if i != j]) for z in (x, y)]
        plain.append(sum(within) - 2 * np.mean([k(a, b) for a in x for b in y]))
    assert training.mmd(x, y) == pytest.approx(np.mean(plain)) and training.mmd(x + 3, y) > 10 * abs(training.mmd(x, y)) and training.mmd(x[:1], y[:1]) == 0
    kernels = {"encoder.0": np.ones((2, 2)), "to_output.projection": np.ones((9, 9))}
    assert training.kernel_l2(kernels, 0.5) == 2.0 and training.kernel_l2(kernels, 0) == 0


def test_variance_ratio_is_that_of_the_dense_likelihood():
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(12), 3)
    x = np.column_stack([np.ones(36), rng.normal(size=36), np.ones(36)])  # a column twice
    y = x[:, 1] + rng.normal(size=12)[group] * 1.5 + rng.normal(size=36)

    def dense(log_ratio):
        v = np.eye(36) + math.exp(log_ratio) * (group[:, None] == group)
        q = x[:, :2]
        inverse = np.linalg.inv(v)
        a = q.T @ inverse @ q
        rest = y - q @ np.linalg.solve(a, q.T @ inverse @ y)
        return 34 * math.log(rest @ inverse @ rest) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]

    cohort = models.Cohort.of(np.column_stack([x, y]), group)
    got = math.log(models.variance_ratio(cohort))
    assert all(dense(got) <= dense(got + h) + 1e-9 for h in (-1e-3, 1e-3, -0.5, 0.5))
    fit = models.Restricted(cohort)
    assert fit.deviance(2.0) - fit.deviance(0.3) == pytest.approx(dense(math.log(2.0)) - dense(math.log(0.3)))
    assert models.FRACTIONS[1:3] == (0.5, 0.2) and models.STEPS == 5000


def test_orientation_looks_at_normalized_names():
    arrays, plain = [f"S{k}_(PrimeView).CEL.gz" for k in range(5)], [f"p_{k}" for k in range(5)]
    assert [ids.plain_sample_id(x) for x in (arrays[0], " a/b.cel/ ", 7)] == ["S0", "b", "7"]
    assert store.infer_orientation(arrays, plain) == "samples_columns"  # the suffixes are gone, the underscores are not
    assert store.infer_orientation(["x.CEL.other"], ["y"]) == "samples_rows" == store.infer_orientation(["a"], ["b", "c"])


def test_a_feature_without_training_values_fails(spark):
    rows = frame(spark, [(1, "a", 1.0, True), (1, "a", None, False), (1, "b", None, True), (1, "b", 2.0, False)], "fold int, feature string, value double, is_train boolean")
    assert normalize.impute_and_scale(rows.filter("feature = 'a'"), ["fold"]).count() == 2
    with pytest.raises(Exception, match="no training value"):
        normalize.impute_and_scale(rows, ["fold"]).collect()


def test_running_best_needs_a_real_gain(spark):
    scores = [5.0, 5.0 - 5e-13, 5.0 - 9e-13, 5.0 - 15e-13, 6.0, 1.0]
    rows = frame(spark, [("r", k + 1, s) for k, s in enumerate(scores)], "run string, epoch bigint, score double")
    got = [r.best for r in history.running_best(rows).orderBy("epoch").collect()]
    assert got == [5.0, 5.0, 5.0, scores[3], scores[3], 1.0]


def test_stratified_folds_spread_strata():
    strata = {f"d{k:03d}": "abc"[k % 3] for k in range(61)}
    found = splits.stratified_folds(strata, 5, 3, 9)
    assert found == splits.stratified_folds(strata, 5, 3, 9) and len(found) == 183
    for repeat in (1, 2, 3):
        for s in ("", "a", "b", "c"):
            counts = np.bincount([f - 1 for r, d, f in found if r == repeat and (not s or strata[d] == s)], minlength=5)
            assert counts.max() - counts.min() <= 1
    rare = splits.stratified_folds({"a": "x", "b": "y", "c": "y", "d": "y"}, 2, 1, 0)
    assert sorted(f for _, _, f in rare) == [1, 1, 2, 2]


def test_split_of_all_methods_and_its_rows(spark):
    samples = [f"s{k}" for k in range(12)]
    matrices = frame(spark, [(m, s) for m in ("a", "b") for s in samples] + [("a", "only")], "method string, sample string")
    occ = frame(spark, [(s, f"g{k // 2}") for k, s in enumerate(samples)], "sample string, study string")
    parts = frame(spark, [(f"g{k}", f"g{k}") for k in range(6)], "study string, component string")
    extra = frame(spark, [("x1", "train"), ("x2", "validation")], "sample string, split string")
    split = splits.all_methods_split(spark, matrices, occ, parts, extra, 3, 0.5, 0.25)
    assert split.count() == 14 and split.filter("domain = 'supervised' AND study IS NULL").count() == 2
    with pytest.raises(ContractError):
        splits.all_methods_split(spark, matrices, occ, parts, extra.withColumn("split", F.lit("test")), 3, 0.5, 0.25)
    array = split.filter("domain = 'array'").select("sample", "split")
    index = frame(spark, [(s, k) for k, s in enumerate(samples)], "sample string, matrix_row int")
    assert splits.rows_of_split(array, index).count() == 12
    with pytest.raises(ContractError, match="no matrix row"):
        splits.rows_of_split(array, index.limit(11))

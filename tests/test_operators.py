"""Small fixtures with known numbers, invariants of fits, and one violation for each contract."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.functions import ids
from assaylake.operators import contracts, history, models, normalize, outcomes, qc, reports, splits, store
from assaylake.plans import catalogue
from assaylake.sources import npy, tables

DATA = "/root/testdata/sf0.001"


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_sample_ids(spark):
    given = ["a/b/101_1_(PrimeView).CEL.gz", " 7_L.CEL", "X.cel.gz", "plain", "Y.CeL"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string")
    got = [r.s for r in df.orderBy("k").select(ids.sample_id(F.col("x")).alias("s")).collect()]
    assert got == ["101_1", "7_L", "X", "plain", "Y.CeL"]
    legacy = [r.s for r in df.orderBy("k").select(ids.legacy_id(F.col("x")).alias("s")).collect()]
    assert legacy == ["101_1", "7_L", "X.CEL.GZ".replace(".CEL.GZ", ""), "PLAIN", "Y"]


def test_donors_of_both_modules_differ(spark):
    row = spark.createDataFrame([("A_B_L",)], "x string").select(ids.donor_of_biopsy(F.col("x")).alias("a"), ids.donor_of_patient(F.col("x")).alias("b"), ids.tissue(F.col("x")).alias("t")).first()
    assert (row.a, row.b, row.t) == ("A_B", "A", "L")


def test_slugs_and_sizes(spark):
    row = spark.createDataFrame([("Ä / b-C", 1536)], "x string, n bigint").select(ids.slug(F.col("x")).alias("s"), ids.byte_size(F.col("n")).alias("n"), ids.slug(F.lit("--")).alias("d")).first()
    assert (row.s, row.n, row.d) == ("b_c", "1.5 KiB", "model")
    assert ids.number_slug(-0.5) == "m0p5"


def test_orientation():
    assert store.infer_orientation(["p1", "p2", "p3"], ["101_(PrimeView).CEL", "102_(PrimeView).CEL"]) == "samples_columns"
    assert store.infer_orientation(["a", "b"], ["x", "y", "z"]) == "samples_rows"


def test_matrix_with_samples_in_columns(spark):
    wide = spark.createDataFrame([(0, "a", "1", "4"), (1, "b", "2", "5"), (2, "c", "3", "6")], ["row", "probe", "101_1_(PrimeView).CEL", "102_1_(PrimeView).CEL"])
    got = values(store.vector_table(wide, "probe", "samples_columns", "row"), "sample_id", "values")
    assert got == [("101_1", [1.0, 2.0, 3.0]), ("102_1", [4.0, 5.0, 6.0])]


def test_quantile_reference_and_ties(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 8.0]), (1, [4.0, 4.0, 2.0])], "sample_id int, values array<double>")
    target = normalize.quantile_reference(rows)
    assert values(target, "rank", "target") == [(0, 1.5), (1, 3.0), (2, 6.0)]
    tied = dict(enumerate(normalize.apply_reference(rows, target, "sample_id").filter("sample_id = 1").first()["values"]))
    assert tied[0] == tied[1] == pytest.approx(np.log2(4.5))


def test_flat_feature_is_centered_only(spark):
    rows = spark.createDataFrame([("s", [1.0, 2.0]), ("s", [1.0, 4.0])], "study string, values array<double>")
    got = normalize.standardize(rows, normalize.fit_centers(rows, ["study"]), ["study"]).select("values").collect()
    assert sorted(r.values for r in got) == [[0.0, -1.0], [0.0, 1.0]]


def test_held_out_rows_do_not_move_the_fit(spark):
    base = [("a", "f", True, 1.0), ("b", "f", True, None), ("c", "f", True, 3.0), ("d", "f", False, 9.0)]
    fit = lambda rows: {r.patient: r.value for r in normalize.impute_and_scale(spark.createDataFrame(rows, "patient string, feature string, is_train boolean, value double").withColumn("fold", F.lit(0)), ["fold"]).collect()}
    one, two = fit(base), fit([*base[:3], ("d", "f", False, -500.0)])
    assert {k: v for k, v in one.items() if k != "d"} == {k: v for k, v in two.items() if k != "d"}
    assert one["b"] == pytest.approx(0.0)


def test_histogram_holds_its_upper_edge(spark):
    rows = spark.createDataFrame([(1, float(k)) for k in range(11)], "g int, value double")
    got = values(qc.histogram(rows, ["g"], 0.0, 1.0, 5), "bin", "n")
    assert got == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]


def test_quantile_strata_keep_ties_together(spark):
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1, 2, 2, 2, 3, 4, 5, 9])], "k int, v double")
    got = [s for _, s in values(splits.quantile_strata(rows, "v"), "k", "stratum")]
    assert len({got[k] for k in (1, 2, 3)}) == 1 and got == sorted(got)


def test_components_follow_chains(spark, tmp_path):
    rows = spark.createDataFrame([(1, "G1"), (1, "G2"), (2, "G2"), (2, "G3"), (3, "G9")], "sample int, study string")
    got = values(splits.study_components(spark, rows, f"file://{tmp_path}/c"), "study", "component")
    assert got == [("G1", "G1"), ("G2", "G1"), ("G3", "G1"), ("G9", "G9")]


def test_balanced_assignment():
    sizes = {f"G{k}": 10 for k in range(10)}
    a, b = (splits.balanced_assignment(sizes, 5, 0.8, 0.1) for _ in range(2))
    assert a == b and sorted(list(a.values()).count(x) for x in ("train", "validation", "test")) == [1, 1, 8]
    with pytest.raises(ValueError):
        splits.balanced_assignment({"a": 1, "b": 1}, 5, 0.8, 0.1)


def test_component_split_keeps_all_samples(spark, monkeypatch):
    """More components than were once collected; the filling itself is tested above."""
    monkeypatch.setattr(splits, "balanced_assignment", lambda sizes, *_: {c: ("train", "validation", "test")[k % 3] for k, c in enumerate(sizes)})
    samples = spark.range(100_050).select(F.col("id").alias("sample"), F.when(F.col("id") < 40, F.col("id") % 4).alias("study"))
    components = spark.createDataFrame([(k, k // 2) for k in range(4)], "study bigint, component bigint")
    got = splits.component_split(spark, samples, components, 5, 0.8, 0.1)
    n = got.agg(F.count("split").alias("n"), F.countDistinct("sample").alias("samples"), F.countDistinct("component").alias("components")).first()
    assert tuple(n) == (100_050, 100_050, 100_012)
    assert got.groupBy("component").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_split_query_gives_every_sample_a_part(spark):
    rows = catalogue.QUERIES["split_apply"](spark, DATA).collect()
    want = {r.vec_id: r.label for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    assert {r["sample"]: r.study for r in rows} == want and len(rows) == len(want)
    assert {r.split for r in rows} == {"train", "validation", "test"}
    assert len({(r.study, r.split) for r in rows}) == len(set(want.values()))


def test_nested_manifest_is_pure():
    rows = splits.nested_manifest([f"D{k}" for k in range(20)], 5, 2, 4, 11)
    assert rows == splits.nested_manifest([f"D{k}" for k in range(20)], 5, 2, 4, 11)
    for repeat in range(2):
        tested = [d for r, _, d, o, _ in rows if r == repeat and o == "outer_test"]
        assert sorted(tested) == sorted(f"D{k}" for k in range(20))


def roles_are_whole(rows, donors, outer, repeats, inner):
    assert len(rows) == len(set(map(tuple, rows))) == len(donors) * outer * repeats
    for repeat in range(repeats):
        tested = [r.donor for r in rows if r.repeat == repeat and r.outer_role == "outer_test"]
        assert sorted(tested) == sorted(donors)
        for fold in range(outer):
            here = [r for r in rows if (r.repeat, r.fold) == (repeat, fold)]
            assert {r.donor for r in here} == donors
            n = {k: sum(r.inner_role == k for r in here) for k in ("inner_train", "inner_validation", "not_applicable")}
            assert n["not_applicable"] == len(donors) // outer + (fold < len(donors) % outer) == sum(r.outer_role == "outer_test" for r in here)
            assert n["inner_validation"] == -(-(len(donors) - n["not_applicable"]) // inner) and sum(n.values()) == len(donors)


def test_nested_manifest_of_many_donors(spark):
    donors = spark.range(1234).select(F.concat(F.lit("D"), F.col("id") % 1201).alias("donor"))
    made = splits.nested_manifest_of(donors, 4, 2, 5, 11)
    rows = made.collect()
    roles_are_whole(rows, {f"D{k}" for k in range(1201)}, 4, 2, 5)
    assert sorted(rows) == sorted(splits.nested_manifest_of(donors.repartition(7), 4, 2, 5, 11).collect())
    assert contracts.nested_leaks(made).count() == 0
    assert contracts.nested_leaks(made.unionByName(made.limit(1).withColumn("outer_role", F.lit("other")))).count() == 1
    folds = {k: frozenset(r.donor for r in rows if (r.repeat, r.fold) == (k, 0) and r.outer_role == "outer_test") for k in range(2)}
    assert folds[0] != folds[1]
    with pytest.raises(ValueError):
        splits.nested_manifest_of(donors.limit(3), 4, 2, 5, 11)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_nested_manifest_query_holds_every_donor(spark):
    donors = {str(r.c_custkey // 2) for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    roles_are_whole(catalogue.QUERIES["nested_manifest"](spark, DATA).collect(), donors, 3, 2, 2)


def test_sweep(spark):
    runs = splits.expand_sweep(spark, {"a": {"fixed": {"x": 1}, "grid": {"y": [1, 2], "z": [3, 4]}}}, {"x", "y", "z"}).collect()
    assert [r.array_index for r in runs] == [1, 2, 3, 4] and '"z": 4' in runs[1].settings
    with pytest.raises(ValueError):
        splits.expand_sweep(spark, {"a": {"fixed": {"q": 1}}}, {"x"})
    with pytest.raises(ValueError):
        splits.expand_sweep(spark, {"a": {"fixed": {"x": 1}, "grid": {"x": [1]}}}, {"x"})


def test_deltas(spark):
    m = spark.createDataFrame([("time", 0, 0, 5.0), ("a", 0, 0, 3.5), ("time", 0, 1, 4.0), ("a", 0, 1, 3.0)], "model_id string, repeat int, fold int, rmse double")
    assert values(reports.delta_to(m, "time", ["repeat", "fold"]).filter("model_id = 'a'"), "delta") == [(1.0,), (1.5,)]
    with pytest.raises(Exception, match="lacks the baseline"):
        reports.delta_to(m.filter("NOT (model_id = 'time' AND fold = 1)"), "time", ["repeat", "fold"]).collect()


def test_ties_go_to_the_smaller_id(spark):
    m = spark.createDataFrame([(0, 1.0, "b"), (0, 1.0, "a"), (0, 2.0, "c")], "fold int, rmse double, model_id string")
    assert values(reports.best_of(m, ["fold"], ["rmse", "model_id"]), "fold", "model_id") == [(0, "a")]


def test_wide_to_long(spark):
    wide = spark.createDataFrame([("p", 50.0, None), ("q", 55.0, 60.0)], "patient string, egfr_7d double, egfr_3m double")
    assert values(outcomes.wide_to_long(wide), "patient", "time", "egfr") == [("p", "7d", 50.0), ("q", "3m", 60.0), ("q", "7d", 55.0)]


def test_moving_average(spark):
    rows = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "run int, epoch bigint, score double")
    assert values(history.moving_average(rows), "epoch", "ema") == [(1, 10.0), (2, 11.0)]


def test_best_epoch_skips_what_is_not_finite(spark):
    rows = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 3.0), (1, 3, 3.0), (1, 4, None)], "run int, epoch bigint, score double")
    assert values(history.best_epoch(rows), "run", "epoch") == [(1, 2)]


def test_median_polish_is_exact_on_an_additive_table():
    rows, columns = np.array([0.0, 1.0, 5.0]), np.array([2.0, -2.0, 0.0])
    overall, r, c = models.polish(7 + rows[:, None] + columns[None])
    assert np.abs(overall + r[:, None] + c[None] - (7 + rows[:, None] + columns[None])).max() < 1e-7


def test_variance_ratio_against_a_grid():
    rng = np.random.default_rng(0)
    group = np.repeat(np.arange(40), 4)
    y = rng.normal(size=40)[group] * 1.5 + rng.normal(size=160)
    x = np.ones((160, 1))
    cohort = models.Cohort.of(np.column_stack([x, y]), group)
    found = models.variance_ratio(cohort)
    grid = np.linspace(-9, 9, 1801)
    fit = models.Restricted(cohort)
    best = grid[np.argmin([fit.deviance(np.exp(g)) for g in grid])]
    assert abs(np.log(found) - best) < 0.02


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 30))
    y = x[:, :3] @ [3.0, -2.0, 1.0] + rng.normal(size=80)
    most = np.abs(x.T @ y).max() / 80
    path = models.lasso_path(x.T @ x, x.T @ y, y @ y, 80, most * np.array([1.0, 0.3]))
    assert not path[:, 0].any()
    slope = x.T @ (y - x @ path[:, 1]) / 80
    assert np.all(np.abs(slope) <= 0.3 * most + 1e-5) and np.abs(path[:, 1]).max() > 1


def test_pca_keeps_out_held_out_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 5))
    def scores(y):
        rows = [(0, k, k < 10, [float(v) for v in y[k]]) for k in range(12)]
        return {r.id: r.scores for r in models.pca(spark.createDataFrame(rows, "fold bigint, id bigint, is_train boolean, x array<double>"), 2).collect()}
    moved = x.copy()
    moved[10:] += 100
    a, b = scores(x), scores(moved)
    assert np.allclose([a[k] for k in range(10)], [b[k] for k in range(10)])
    assert np.allclose(np.mean([a[k] for k in range(10)], axis=0), 0)


def test_contracts_fail_closed(spark):
    split = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "study string, split string")
    for violations in (contracts.crossing(split, "study", "split"), contracts.repeated(split, ["study"]), contracts.wrong_labels(split, "split", {"train", "validation", "test"}, True)):
        with pytest.raises(contracts.ContractError):
            contracts.enforce(violations, "split")
    contracts.enforce(contracts.wrong_labels(split, "split", {"train", "test"}, True), "split")
    order = spark.createDataFrame([(0,), (2,)], "ord int")
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.not_permutation(order, "ord"), "order")
    with pytest.raises(contracts.ContractError):
        contracts.assert_contract({"format": 3}, {"format": 4})


def test_npy_source(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    np.save(tmp_path / "m.npy", x)
    npy.register(spark)
    got = values(spark.read.format("npy").load(str(tmp_path / "m.npy")), "ord", "values")
    assert got == [(k, list(map(float, x[k]))) for k in range(4)]
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    with pytest.raises(Exception, match="row order"):
        spark.read.format("npy").load(str(tmp_path / "f.npy")).count()


def test_soft_blocks(spark):
    text = ["!header = x", "^SAMPLE = GSM1", "!Sample_title = one", "!Sample_platform_id = GPL1", "^SAMPLE = GSM2", "!Sample_title = two"]
    got = values(tables.soft_samples(spark.createDataFrame(list(enumerate(text)), "line_no bigint, line string")), "sample", "title")
    assert got == [("GSM1", "one"), ("GSM2", "two")]


def test_requests_and_folders(tmp_path):
    with pytest.raises(ValueError):
        tables.load_request('{"method": "x", "more": 1}')
    assert tables.resolve_data_directory("/x", "V", ()) == "/x"
    assert tables.resolve_data_directory(None, "V", (), {"V": "/y"}) == "/y"


def test_verified_write(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0])], "k int, v array<double>")
    assert tables.write_verified(df, f"file://{tmp_path}/t", ["k"]).count() == 1


def test_stream_state_equals_the_batch_fold(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from assaylake.streaming.histories import follow

    rows = [(1, k + 1, float(s)) for k, s in enumerate([5, 4, 6])]
    spark.createDataFrame(rows, "run bigint, epoch bigint, score double").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("run bigint, epoch bigint, score double").parquet(f"{tmp_path}/in")
    out = follow(stream).writeStream.format("memory").queryName("followed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = values(spark.table("followed"), "epoch", "best", "ema")
    assert got == [(1, 5.0, 5.0), (2, 4.0, pytest.approx(4.9)), (3, 4.0, pytest.approx(5.01))]


def test_streaming_metrics_are_appended_once(spark, tmp_path):
    from assaylake.streaming.histories import append_metrics

    spark.createDataFrame([(1, 1, 2.0)], "run bigint, epoch bigint, score double").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("run bigint, epoch bigint, score double").parquet(f"{tmp_path}/in")
        append_metrics(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1

"""Splits and folds over any number of components and donors, stores that are refused, saved splits that differ."""

import pytest
from pyspark.sql import functions as F

from assaylake.operators import history, order, splits
from assaylake.operators.store import ExpressionStore
from assaylake.session import work_folder


def test_many_components_fill_the_parts(spark, monkeypatch):
    monkeypatch.setattr(splits, "LARGEST", 5)
    studies = [(f"s{k}", k % 200 if k >= 60 else k % 3) for k in range(1200)]
    samples = spark.createDataFrame(studies, "sample string, study bigint")
    parts = spark.createDataFrame([(k, k) for k in range(200)], "study bigint, component bigint")
    got = splits.component_split(spark, samples, parts, 3, 0.7, 0.2)
    rows = got.toPandas()
    assert len(rows) == 1200 and rows.groupby("component").split.nunique().max() == 1
    shares = rows.split.value_counts(normalize=True)
    assert shares["train"] == pytest.approx(0.7, abs=0.02) and shares["validation"] == pytest.approx(0.2, abs=0.02) and shares["test"] == pytest.approx(0.1, abs=0.02)
    again = splits.component_split(spark, samples.repartition(7), parts, 3, 0.7, 0.2).toPandas()
    assert sorted(zip(rows["sample"], rows.split, strict=True)) == sorted(zip(again["sample"], again.split, strict=True))


def test_strata_are_spread_over_folds(spark):
    donors = spark.createDataFrame([(f"d{k}", "abc"[(k % 10) // 4]) for k in range(203)], "donor string, stratum string")
    rows = splits.stratified_folds_of(donors, 5, 3, 9).join(donors, "donor").toPandas()
    assert len(rows) == 3 * 203
    for _, own in rows.groupby("repeat"):
        assert own.donor.is_unique and own.fold.value_counts().max() - own.fold.value_counts().min() <= 1
        per = own.groupby(["stratum", "fold"]).size().unstack(fill_value=0)
        assert (per.max(axis=1) - per.min(axis=1)).max() <= 1
    assert rows.pivot(index="donor", columns="repeat", values="fold").nunique(axis=1).max() > 1
    rare = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y"), ("d", "y")], "donor string, stratum string")
    found = splits.stratified_folds_of(rare, 2, 1, 0).toPandas()
    assert sorted(found.fold) == [1, 1, 2, 2]
    with pytest.raises(ValueError, match="no more than donors"):
        splits.stratified_folds_of(rare, 5, 1, 0)
    with pytest.raises(Exception, match="more than one stratum"):
        splits.stratified_folds_of(rare.unionByName(spark.createDataFrame([("a", "y")], "donor string, stratum string")), 2, 1, 0)


def test_a_saved_split_that_differs_is_named(spark):
    made = spark.createDataFrame([("a", "array", "train", "c1"), ("b", "array", "test", "c2"), ("c", "supervised", "train", None)], "sample string, domain string, split string, component string")
    assert splits.combined_split_faults(made, made).count() == 0
    saved = spark.createDataFrame([("a", "array", "validation", "c9"), ("b", "array", "test", "c2"), ("b", "array", "test", "c2"), ("x", "array", "train", "c1")], made.schema)
    got = sorted(tuple(r) for r in splits.combined_split_faults(saved, made).collect())
    assert got == [("a", "split,component"), ("b", "repeated"), ("c", "missing"), ("x", "unknown")]


def test_a_store_without_its_tables_is_refused(spark):
    root = work_folder(spark, "store")
    store = ExpressionStore(spark, root)
    for name in ("samples", "occurrences", "probes"):
        store.write(name, spark.createDataFrame([("a", "s")], "sample string, study string"))
    with pytest.raises(FileNotFoundError, match="matrix"):
        ExpressionStore.opened(spark, root)
    store.write("matrix", spark.createDataFrame([("a", "m", [1.0])], "sample_id string, method string, values array<double>"))
    assert ExpressionStore.opened(spark, root).view("m").count() == 1
    store.write("probes", spark.createDataFrame([(1,)], "probe_id int"))
    with pytest.raises(ValueError, match="not text"):
        ExpressionStore.opened(spark, root)


def test_quantiles_of_heavy_ties_and_empty_groups(spark):
    rows = spark.createDataFrame([("a", 0.0)] * 900 + [("a", float(k)) for k in range(1, 101)] + [("b", 5.0), ("c", None), (None, 1.0), (None, 2.0)], "g string, v double").repartition(6)
    got = {r.g: r.q for r in order.quantiles(rows, ["g"], "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert got[None] == pytest.approx([1.0, 1.5, 1.95, 2.0]) and got["b"] == [5.0] * 4 and "c" not in got
    assert got["a"] == pytest.approx([0.0, 0.0, 0.95 * 999 - 899, 100.0])
    assert order.quantiles(rows.limit(0), [], "v", (0.5,)).count() == 0
    assert order.quantiles(rows.filter("g = 'a'"), [], "v", (0.5,)).first().q == [0.0]


def test_places_are_gapless(spark):
    rows = spark.createDataFrame([(k * 7 % 1000,) for k in range(1000)], "k int").repartition(9)
    got = {r.k: r.position for r in order.numbered(rows, [F.col("k").desc()]).collect()}
    assert got == {k: 999 - k for k in range(1000)}


def test_runs_with_gaps_are_judged_by_loss(spark):
    rows = spark.createDataFrame([(1, 1, 5.0, 9.0), (1, 2, 4.0, 1.0), (2, 1, None, 3.0), (2, 2, 0.1, 8.0), (2, 3, float("nan"), None)], "run int, epoch int, score double, loss double")
    assert sorted((r.run, r.epoch) for r in history.best_epoch(rows, "loss").collect()) == [(1, 2), (2, 1)]


def test_settings_and_widths_are_refused(spark):
    from assaylake.functions import ids
    from assaylake.operators import contracts

    assert len(contracts.SETTINGS) == 30
    good = spark.createDataFrame([(1, 8, 0.0, 0.5, [64, 8], "mse")], "run int, residual_blocks int, dropout double, lr_factor double, hidden_widths array<int>, loss string")
    assert contracts.setting_faults(good, "run", {"loss": {"mse"}}).count() == 0
    bad = spark.createDataFrame([(2, 9, 1.0, 0.0, [], "l9"), (3, None, float("nan"), 1.0, [0], None)], good.schema)
    got = sorted((r.run, r.setting) for r in contracts.setting_faults(bad, "run", {"loss": {"mse"}}).collect())
    assert got == [(k, s) for k in (2, 3) for s in sorted(("residual_blocks", "dropout", "lr_factor", "hidden_widths", "loss"))]
    widths = lambda x: spark.createDataFrame([(x,)], "x string").select(ids.hidden_widths(F.col("x")).alias("w")).first().w
    assert widths("512 -> 256→64; 32,") == [512, 256, 64, 32]
    for x in ("", "1", "8193", "a", ",".join(["8"] * 9), None):
        with pytest.raises(Exception, match="hidden widths"):
            widths(x)

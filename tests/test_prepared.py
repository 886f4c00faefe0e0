"""Versions and restarts, rebuilt matrices, prepared sources, supervised inputs: what they give and what they refuse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import prepared
from assaylake.operators.contracts import ContractError
from assaylake.session import work_folder
from assaylake.sources.versions import Accumulation, Versions


@pytest.fixture
def store(spark):
    return Versions(spark, work_folder(spark, "versions"))


def test_a_version_is_switched_whole_and_the_old_one_stays(spark, store):
    with pytest.raises(ContractError, match="no version"):
        store.read()
    store.replace(spark.range(3), {"made": "a"})
    store.replace(spark.range(5), {"made": "b"})
    assert store.read().count() == 5 and store.read(number=0).count() == 3 and [e["about"]["made"] for e in store.entries()] == ["a", "b"]
    assert store.read({"made": "b"}).count() == 5
    with pytest.raises(ContractError, match="not from"):
        store.read({"made": "a"})

    def refuse(df):
        raise ContractError("not this one")

    with pytest.raises(ContractError, match="not this one"):
        store.replace(spark.range(9), {"made": "c"}, [refuse])
    assert store.read().count() == 5


def units(spark, rows):
    return spark.createDataFrame(rows, "unit string, values array<double>")


def test_sums_count_each_unit_once_after_a_kill(spark, monkeypatch):
    root = work_folder(spark, "sums")
    own = Accumulation(spark, root, {"seed": 1})
    own.add(units(spark, [("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("b", [3.0, 4.0])]), 0)
    assert own.totals() == {"n": 2, "sums": [4.0, 6.0]}
    more = units(spark, [("b", [3.0, 4.0]), ("c", [10.0, 20.0])])

    def killed(folder, about):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:  # all is written, nothing is committed
        patch.setattr(own.versions, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            own.add(more, 1)
    again = Accumulation(spark, root, {"seed": 1})
    assert again.totals() == {"n": 2, "sums": [4.0, 6.0]}
    again.add(more, 1)
    again.add(more, 1)  # repeated after the commit
    again.add(units(spark, []), 2)
    assert again.totals() == {"n": 3, "sums": [14.0, 26.0]} and sorted(r.unit for r in again.done().collect()) == ["a", "b", "c"]
    with pytest.raises(ContractError, match="another contract"):
        Accumulation(spark, root, {"seed": 2})


def test_a_stream_that_is_killed_goes_on(spark, monkeypatch):
    source, root, checkpoint = (work_folder(spark, n) for n in ("in", "sums", "checkpoint"))
    schema = "unit string, values array<double>"
    units(spark, [(f"u{k}", [float(k), 1.0]) for k in range(10)]).repartition(2).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    own = Accumulation(spark, root, {"v": 1})
    commit, calls = own.versions.commit, []

    def fails_after_commit(folder, about):
        entry = commit(folder, about)
        calls.append(about["batch"])
        if len(calls) == 1:
            raise RuntimeError("killed behind the commit")
        return entry

    monkeypatch.setattr(own.versions, "commit", fails_after_commit)
    with pytest.raises(Exception, match="killed"):
        own.follow(stream(), checkpoint).awaitTermination()
    units(spark, [("u3", [3.0, 1.0]), ("u99", [99.0, 1.0])]).write.mode("append").parquet(source)
    Accumulation(spark, root, {"v": 1}).follow(stream(), checkpoint).awaitTermination()
    assert Accumulation(spark, root, {"v": 1}).totals() == {"n": 11, "sums": [45.0 + 99.0, 11.0]}


# --- rebuilt matrices


def frozen(spark, rows=(("GEO:gsm1", "train"), ("GEO:GSM2", " Validation"), ("GEO:GSM3", "test"), ("OWN:X", "train"))):
    return spark.createDataFrame(list(rows), "sample_key string, split string")


def index(spark, rows=(("GSM1", 0), ("GSM2", 1), ("gsm3", 2))):
    return spark.createDataFrame(list(rows), "GSM string, global_row_python bigint")


RAW = [[1.0, 4.0, 2.0], [2.0, 8.0, 4.0], [1000.0, 3000.0, 3000.0]]


def raw(spark, values=None):
    return spark.createDataFrame(list(enumerate(values or RAW)), "ord bigint, values array<double>")


def test_a_matrix_is_rebuilt_from_training_rows_alone(spark, store):
    entry = prepared.rebuild(spark, store, raw(spark), index(spark), frozen(spark))
    got = {r.ord: r["values"] for r in store.read().collect()}
    assert np.allclose(got[0], np.log2([1, 4, 2])) and np.allclose(got[1], np.log2([1, 4, 2])) and np.allclose(got[2], [0, np.log2(3), np.log2(3)], atol=1e-6)
    about = entry["about"]
    assert about["shape"] == [3, 3] and (about["n_train"], about["n_validation"], about["n_test"]) == (1, 1, 1)
    other = prepared.rebuild(spark, store, raw(spark), index(spark), frozen(spark, (("GEO:GSM1", "test"), ("GEO:GSM2", "train"), ("GEO:GSM3", "validation"))))
    assert other["about"]["training_ids_sha256"] != about["training_ids_sha256"] and other["number"] == 1
    assert np.allclose({r.ord: r["values"] for r in store.read(number=0).collect()}[0], np.log2([1, 4, 2]))  # the one before is kept
    changed = raw(spark, [RAW[0], [9.0, 8.0, 7.0], RAW[2]])
    prepared.rebuild(spark, store, changed, index(spark), frozen(spark))
    assert np.allclose({r.ord: r["values"] for r in store.read().collect()}[0], got[0])


@pytest.mark.parametrize(("change", "message"), [
    (dict(index=(("GSM1", 0), ("GSM2", 0), ("GSM3", 2))), "every row once"), (dict(index=(("GSM1", 0), ("GSM2", 1))), "every row once"), (dict(index=(("GSM1", 0), ("gsm1", 1), ("GSM3", 2))), "repeat"),
    (dict(frozen=(("GEO:GSM1", "train"), ("GEO:GSM2", "held"), ("GEO:GSM3", "test"))), "labels"), (dict(frozen=(("GEO:GSM1", "train"), ("GEO:gsm1", "test"), ("GEO:GSM3", "validation"))), "twice"),
    (dict(frozen=(("GEO:GSM1", "train"), ("GEO:GSM9", "test"), ("GEO:GSM3", "validation"))), "lacks"), (dict(frozen=(("GEO:GSM1", "train"), ("GEO:GSM3", "validation"))), "no rows for"),
    (dict(raw=[[1.0, 0.0, 2.0], *RAW[1:]]), "positive"), (dict(raw=[RAW[0], [1.0, float("nan"), 2.0], RAW[2]]), "positive"),
])
def test_a_rebuild_is_refused(spark, store, change, message):
    store.replace(spark.range(1), {"method": "old"})
    with pytest.raises(Exception, match=message):
        prepared.rebuild(spark, store, raw(spark, change.get("raw")), index(spark, change["index"]) if "index" in change else index(spark), frozen(spark, change["frozen"]) if "frozen" in change else frozen(spark))
    assert store.last()["about"] == {"method": "old"}  # nothing was switched


def test_a_matrix_without_provenance_is_refused(spark, store):
    store.replace(spark.range(1), {"method": "something else"})
    with pytest.raises(ContractError, match="made from"):
        prepared.candidate(spark, store)


# --- prepared sources


def test_a_prepared_source_gives_its_rows_and_columns(spark, store):
    rows = spark.createDataFrame([(0, "S2", "geo", "train", "d1", None), (1, "S0", "geo", "validation", "d2", None), (2, "S1", "own", "validation", "d1", "D7")], "ord bigint, sample_id string, kind string, split string, domain string, donor string")
    values = spark.createDataFrame([(f"S{k}", [10.0 * k + j for j in range(4)]) for k in range(4)], "sample_id string, values array<double>")
    affine = spark.createDataFrame([("d1", [1.0, 1.0], [2.0, 2.0]), ("d2", [0.0, 0.0], [1.0, 1.0])], "domain string, center array<double>, scale array<double>")
    matrix = {"method": "m", "training_ids_sha256": "t"}
    prepared.prepare(spark, store, rows, ["p0", "p1", "p2", "p3"], ["p3", "p0"], matrix, affine)
    got = [(r.ord, r.sample_id, r["values"]) for r in prepared.load(store, values, matrix).orderBy("ord").collect()]
    assert got == [(0, "S2", [11.0, 9.5]), (1, "S0", [3.0, 0.0]), (2, "S1", [6.0, 4.5])]
    assert [(r.place, r.sample_id, r.donor) for r in prepared.validation_partition(store, matrix).orderBy("place").collect()] == [(0, "S0", None), (1, "S1", "D7")]
    with pytest.raises(ContractError, match="another matrix"):
        prepared.load(store, values, {**matrix, "training_ids_sha256": "other"})
    with pytest.raises(Exception, match="lacks S2"):
        prepared.load(store, values.filter("sample_id <> 'S2'"), matrix).collect()
    with pytest.raises(ValueError, match="missing"):
        prepared.prepare(spark, store, rows, ["p0"], ["p9"], matrix)
    with pytest.raises(ContractError, match="twice"):
        prepared.prepare(spark, store, rows.withColumn("sample_id", F.lit("S1")), ["p0"], ["p0"], matrix)
    with pytest.raises(ContractError, match="places"):
        prepared.prepare(spark, store, rows.withColumn("ord", F.col("ord") + 1), ["p0"], ["p0"], matrix)
    # Another membership under the same contract: the entry is right, the rows are not.
    folder = store.last()["folder"]
    rows.filter("ord < 2").write.mode("overwrite").parquet(f"{store.root}/{folder}/data")
    with pytest.raises(ContractError, match="samples are not"):
        prepared.load(store, values, matrix)


def test_supervised_inputs_of_all_methods_are_in_one_order(spark):
    wanted = spark.createDataFrame([(0, "b.CEL", "x"), (1, "a", "y")], "ord bigint, sample_id string, role string")
    one = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [4.0, 5.0, 6.0]), ("c", [0.0, 0.0, 0.0])], "sample_id string, values array<double>")
    two = spark.createDataFrame([("a", [3.0, 1.0]), ("b", [6.0, 4.0])], "sample_id string, values array<double>")
    methods = {"raw": (one, ["p", "q", "r"]), "std": (two, ["r", "p"])}
    got = prepared.supervised(spark, wanted, methods, ["r", "p"], {"std": ([1.0, 0.0], [2.0, 1.0])}, spark.createDataFrame([("a",)], "sample_id string"))
    rows = [(r.method, r.ord, r.sample_id, r.role, r.has_outcome, r["values"]) for r in got.orderBy("method", "ord").collect()]
    assert rows == [("raw", 0, "b", "x", False, [6.0, 4.0]), ("raw", 1, "a", "y", True, [3.0, 1.0]), ("std", 0, "b", "x", False, [2.5, 4.0]), ("std", 1, "a", "y", True, [1.0, 1.0])]
    with pytest.raises(ContractError, match="raw has samples twice"):
        prepared.supervised(spark, wanted, {"raw": (one.unionByName(one), ["p", "q", "r"])}, ["p"])
    with pytest.raises(ValueError, match="missing"):
        prepared.supervised(spark, wanted, methods, ["zz"])
    with pytest.raises(Exception, match="std lacks b"):
        prepared.supervised(spark, wanted, {"std": (two.filter("sample_id = 'a'"), ["r", "p"])}, ["p"]).collect()
    with pytest.raises(ContractError, match="wanted twice"):
        prepared.supervised(spark, wanted.unionByName(wanted), methods, ["p"])

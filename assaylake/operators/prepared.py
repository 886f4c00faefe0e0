"""Matrices that are rebuilt from frozen partitions, and prepared sources: which rows and columns training reads, and from what.

A prepared source is three tables and a contract. Rows: ord, sample_id, kind, split, domain, donor. Columns: where each wanted feature
stands in the matrix. Affine: center and scale of a domain, or of all. The contract says what the matrix must be and which samples it
must have; it is checked before a scan is planned, and the scan is one gather of the stored rows and columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions import ids, vectors
from assaylake.operators import normalize, order
from assaylake.operators.contracts import ContractError, repeated
from assaylake.operators.store import probe_map, resolve_column
from assaylake.session import written
from assaylake.sources.versions import Versions

#: Names under which a store's sample index may hold ids and row numbers, and the labels of partitions. Fixed values.
ID_COLUMNS = ("GSM", "sample_id", "Sample_ID", "sample", "id")
ROW_COLUMNS = ("global_row_python", "row_index_python", "sample_row_python")
PARTS = ("train", "validation", "test")


def _none(df: DataFrame, message: str) -> None:
    """An error that names some of the rows, if there are any."""
    if some := [str(r[0]) for r in df.limit(5).collect()]:
        raise ContractError(f"{message}: {some}")


def native_rows(index: DataFrame, n_rows: int, at: str | None = None) -> DataFrame:
    """sample_id and row of a store's sample index: the rows must be 0 .. n_rows - 1, each once, and the ids must not repeat.

    Without a column of rows the index stands in their order, which `at` names.
    """
    name = resolve_column(index, ID_COLUMNS)
    own = next((c for c in ROW_COLUMNS if c in index.columns), at)
    if own is None:
        raise ContractError("the sample index has no column of rows, nor an order")
    rows = index.select(F.upper(F.trim(F.col(name).cast("string"))).alias("sample_id"), F.col(own).cast("bigint").alias("row"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row").alias("rows"), F.min("row").alias("low"), F.max("row").alias("high")).first()
    if (found["n"], found["rows"]) != (n_rows, n_rows) or n_rows and (found["low"], found["high"]) != (0, n_rows - 1):
        raise ContractError("the sample index does not name every row once")
    _none(repeated(rows, ["sample_id"]), "ids repeat in the sample index")
    return rows


def frozen_partitions(prepared: DataFrame, native: DataFrame, namespace: str = "GEO") -> DataFrame:
    """sample_id, split, row of the frozen samples of a namespace: known labels, no id twice, none that the store lacks, no part empty."""
    if missing := {"sample_key", "split"} - set(prepared.columns):
        raise ContractError(f"the frozen split lacks columns: {sorted(missing)}")
    key = F.col("sample_key").cast("string")
    own = prepared.filter(key.startswith(f"{namespace}:")).select(F.upper(F.trim(ids.id_of_key(key))).alias("sample_id"), F.lower(F.trim("split")).alias("split"))
    _none(own.filter(~F.coalesce(F.col("split").isin(*PARTS), F.lit(False))).select(F.coalesce("split", F.lit("null"))).distinct(), "unexpected labels in the frozen split")
    _none(repeated(own, ["sample_id"]), "samples are frozen twice")
    _none(own.join(native, "sample_id", "left_anti").select("sample_id"), "the store lacks frozen samples")
    have = {r["split"] for r in own.select("split").distinct().collect()}
    if empty := [p for p in PARTS if p not in have]:
        raise ContractError(f"the frozen split has no rows for: {empty}")
    return own.join(native, "sample_id")


def digest(rows: DataFrame, by: str, value: str) -> str:
    """SHA-256 over the SHA-256 of each range partition's values in order, a line each: no task holds more than its partition.

    The number of partitions is fixed, and equal tables are cut alike only by their order; so parts are cut by position.
    """
    import hashlib

    found = order.numbered(rows.select(F.col(by).alias("_by"), F.col(value).cast("string").alias("_v")), [F.col("_by"), F.col("_v")], "_n")
    parts = found.groupBy(F.floor(F.col("_n") / LINES).alias("part")).agg(F.array_sort(F.collect_list(F.struct("_n", "_v"))).alias("r"))  # LINES at most
    each = parts.select("part", F.sha2(F.array_join(F.transform("r", lambda r: r["_v"]), "\n"), 256).alias("d")).orderBy("part").collect()  # a line for LINES rows
    return hashlib.sha256("\n".join(r["d"] for r in each).encode()).hexdigest()


#: Lines of a digest's part.
LINES = 10_000


def finite_matrix(width: int, n_rows: int):
    """A check that a matrix has so many rows of so many finite values."""

    def check(df: DataFrame) -> None:
        found = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("values") != width).alias("short"), F.count_if(~vectors.all_finite("values")).alias("odd")).first()
        if (found["n"], found["short"], found["odd"]) != (n_rows, 0, 0):
            raise ContractError(f"the matrix has {found['n']} of {n_rows} rows, {found['short']} of another width, {found['odd']} with values that are not finite")

    return check


METHOD = "train_reference_quantile_log2"


def rebuild(spark: SparkSession, store: Versions, raw: DataFrame, index: DataFrame, prepared: DataFrame, at: str | None = None) -> dict:
    """Fit the reference on frozen training rows of raw(ord, values), map every row to it, and switch the store to the result.

    Nothing is switched before the staged matrix was read back and found whole and finite; the entry says what it was made from.
    """
    n = raw.count()
    native = written(spark, native_rows(index, n, at), "native-rows")
    parts = written(spark, frozen_partitions(prepared, native), "frozen-partitions")
    train = raw.join(parts.filter("split = 'train'").select(F.col("row").alias("ord")), "ord", "left_semi")
    target = written(spark, normalize.quantile_reference(train), "reference")
    width = target.count()
    mapped = normalize.apply_reference(raw, target, "ord")
    mapped = mapped.join(native.select(F.col("row").alias("ord"), "sample_id"), "ord").select("ord", "sample_id", F.transform("values", lambda x: x.cast("float")).alias("values"))
    counts = {f"n_{r['split']}": r["n"] for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    about = {
        "method": METHOD, "exact_rma": False, "shape": [n, width], "dtype": "float32", **counts,
        "frozen_split_sha256": digest(parts.withColumn("k", F.concat_ws("\t", "sample_id", "split")), "sample_id", "k"),
        "training_ids_sha256": digest(parts.filter("split = 'train'"), "row", "sample_id"),
        "target_sha256": digest(target.withColumn("t", F.hex(F.col("target").cast("string"))), "rank", "t"),
    }
    return store.replace(mapped, about, [finite_matrix(width, n)])


def candidate(spark: SparkSession, store: Versions, number: int | None = None) -> tuple[dict, DataFrame]:
    """The entry and matrix of a version, refused unless it was made by this method."""
    entries = store.entries()
    if not entries:
        raise ContractError(f"{store.root} has no version")
    entry = entries[-1 if number is None else number]
    return entry, store.read({"method": METHOD}, number)


# --- prepared sources


def _contract(rows: DataFrame, matrix: dict) -> dict:
    return {"matrix": {k: matrix[k] for k in ("method", "training_ids_sha256", "frozen_split_sha256") if k in matrix}, "members_sha256": digest(rows, "sample_id", "sample_id")}


def prepare(spark: SparkSession, source: Versions, rows: DataFrame, have: list[str], want: list[str], matrix: dict, affine: DataFrame | None = None) -> dict:
    """Store rows(ord, sample_id, kind, split, domain, donor), where each wanted feature stands, and affine(domain, center, scale).

    Places must be 0, 1, ... and ids must not repeat. `matrix` is what the matrix's entry says of it.
    """
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ord").alias("k"), F.coalesce(F.max("ord") + 1, F.lit(0)).alias("m")).first()
    if not found["n"] == found["k"] == found["m"]:
        raise ContractError("the rows' places are not 0, 1, ...")
    _none(repeated(rows, ["sample_id"]), "samples are there twice")
    folder = source.stage()
    rows = source.write(folder, "data", rows.select("ord", "sample_id", "kind", "split", "domain", "donor"))
    source.write(folder, "columns", spark.createDataFrame(list(enumerate(probe_map(have, want))), "at bigint, position int"))
    if affine is not None:
        source.write(folder, "affine", affine.select("domain", "center", "scale"))
    return source.commit(folder, {**_contract(rows, matrix), "width": len(want), "affine": affine is not None})


def _checked(source: Versions, matrix: dict) -> dict:
    entry = source.last()
    if entry is None:
        raise ContractError(f"{source.root} has no version")
    about = entry["about"]
    wanted = {k: matrix.get(k) for k in about["matrix"]}
    if wanted != about["matrix"]:
        raise ContractError(f"the source was prepared for another matrix: {about['matrix']}")
    if digest(source.table(entry["folder"], "data"), "sample_id", "sample_id") != about["members_sha256"]:
        raise ContractError("the source's samples are not those it was prepared with")
    return entry


def load(source: Versions, values: DataFrame, matrix: dict) -> DataFrame:
    """The prepared rows of a matrix values(sample_id, values) in their places: ord, sample_id, kind, split, domain, donor, values.

    Refused before anything is read if the matrix, or the rows, are not those of the contract; a sample that the matrix lacks is an error.
    """
    entry = _checked(source, matrix)
    folder, about = entry["folder"], entry["about"]
    rows = source.table(folder, "data")
    at = [r["position"] for r in source.table(folder, "columns").orderBy("at").collect()]  # as long as a vector
    lacks = F.raise_error(F.concat(F.lit("the matrix lacks "), F.col("sample_id"))).cast("array<double>")
    found = rows.join(values.select("sample_id", "values"), "sample_id", "left")
    short = F.raise_error(F.lit("a mapped column is missing")).cast("array<double>")
    gathered = vectors.gather(vectors.doubles("values"), F.array(*map(F.lit, at)))
    found = found.withColumn("values", F.when(F.col("values").isNull(), lacks).when(F.size("values") <= max(at, default=-1), short).otherwise(gathered))
    if about["affine"]:
        affine = source.table(folder, "affine")
        unknown = F.raise_error(F.lit("a domain has no center")).cast("array<double>")
        found = found.join(affine, "domain", "left").withColumn("values", F.when(F.col("center").isNull(), unknown).otherwise(vectors.affine("values", "center", "scale"))).drop("center", "scale")
    return found.select("ord", "sample_id", "kind", "split", "domain", "donor", "values")


def validation_partition(source: Versions, matrix: dict) -> DataFrame:
    """The frozen validation rows in their order: place among them, ord, sample_id, domain, donor; there must be some, each with a domain."""
    entry = _checked(source, matrix)
    rows = source.table(entry["folder"], "data").filter("split = 'validation'")
    if rows.isEmpty():
        raise ContractError("no validation rows were frozen")
    _none(rows.filter("domain IS NULL").select("sample_id"), "validation rows without a domain")
    return order.numbered(rows.select("ord", "sample_id", "domain", "donor"), [F.col("ord")], "place")


def supervised(spark: SparkSession, wanted: DataFrame, methods: dict[str, tuple[DataFrame, list[str]]], features: list[str], standardized: dict[str, tuple[list[float], list[float]]] | None = None, measured: DataFrame | None = None) -> DataFrame:
    """The wanted(ord, sample_id, ...) samples of every method in one order and the encoder's features: method, ord, sample_id, ..., has_outcome, values.

    methods: a table (sample_id, values) and its feature names for each. Only methods in `standardized` get center and scale. An id that a
    method has twice, or lacks, and a feature that it lacks, are errors.
    """
    _none(repeated(wanted.withColumn("sample_id", _normal()), ["sample_id"]), "samples are wanted twice")
    out = None
    for name, (table, have) in methods.items():
        at = F.array(*map(F.lit, probe_map(have, features)))
        own = table.select(_normal().alias("sample_id"), "values")
        _none(repeated(own, ["sample_id"]), f"{name} has samples twice")
        lacks = F.raise_error(F.concat(F.lit(f"{name} lacks "), F.col("sample_id"))).cast("array<double>")
        values = F.when(F.col("values").isNull(), lacks).otherwise(vectors.gather(vectors.doubles("values"), at))
        rows = wanted.withColumn("sample_id", _normal()).join(own, "sample_id", "left").withColumn("values", values).withColumn("method", F.lit(name))
        if name in (standardized or {}):
            center, scale = (F.lit(list(map(float, x))) for x in standardized[name])
            rows = rows.withColumn("values", vectors.affine("values", center, scale))
        out = rows if out is None else out.unionByName(rows)
    outcome = F.lit(False)
    if measured is not None:
        out = out.join(measured.select(_normal().alias("sample_id"), F.lit(True).alias("_has")).distinct(), "sample_id", "left")
        outcome = F.coalesce("_has", F.lit(False))
    names = [c for c in wanted.columns if c not in ("ord", "sample_id")]
    return out.select("method", "ord", "sample_id", *names, outcome.alias("has_outcome"), "values")


def _normal() -> Column:
    return ids.sample_id(F.col("sample_id"))



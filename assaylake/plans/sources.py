"""Queries of versions, rebuilt matrices, prepared sources and supervised inputs, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import normalize, order, prepared
from assaylake.plans import inputs as I
from assaylake.plans.catalogue import query, r, rounded
from assaylake.plans.inputs import sql, table
from assaylake.session import work_folder
from assaylake.sources.versions import Accumulation, Versions

NAMES = [f"p{k}" for k in range(64)]
WANTED = NAMES[::-3]
MATRIX = {"method": "given"}


def _frozen(spark, d):
    rows = I.matrix(spark, d)
    return rows.select(F.concat(F.lit("GEO:s"), F.col("sample_id").cast("string")).alias("sample_key"), "split").unionByName(table(spark, d, "supplier").select(F.concat(F.lit("OWN:"), F.col("s_suppkey").cast("string")).alias("sample_key"), F.lit("train").alias("split")))


def _index(spark, d):
    """Samples in the order of their numbers, without a gap."""
    return order.numbered(I.matrix(spark, d).select(F.col("sample_id").alias("k")), [F.col("k")], "row_index_python").select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("GSM"), "row_index_python")


@query("SELECT 'S' || vec_id AS sample_id, CASE WHEN label % 10 < 8 THEN 'train' WHEN label % 10 = 8 THEN 'validation' ELSE 'test' END AS split, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings")
def frozen_partitions(spark, d):
    native = prepared.native_rows(_index(spark, d), table(spark, d, "embeddings").count())
    return prepared.frozen_partitions(_frozen(spark, d), native)


@query(sql(f", k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value, pos) - 1 AS rank FROM raw), t AS (SELECT rank, avg(value) AS target FROM k WHERE split = 'train' GROUP BY rank), m AS (SELECT 'S' || sample_id AS sample_id, pos::INT AS pos, log2(avg(target) OVER (PARTITION BY sample_id, value))::FLOAT::DOUBLE AS mapped FROM k JOIN t USING (rank)) SELECT sample_id, pos, {r('mapped', 4)} AS mapped FROM m", "raw"))
def rebuilt_matrix(spark, d):
    """The matrix that a rebuild switches to, read back through the store."""
    raw = order.numbered(I.raw_matrix(spark, d).select("sample_id", "values"), [F.col("sample_id")], "ord").select("ord", "values")
    store = Versions(spark, work_folder(spark, "rebuilt"))
    prepared.rebuild(spark, store, raw, _index(spark, d), _frozen(spark, d))
    found = prepared.candidate(spark, store)[1].select("sample_id", F.posexplode("values").alias("pos", "mapped"))
    return rounded(found.withColumn("mapped", F.col("mapped").cast("double")), 4)


@query(sql(f", p AS (SELECT sample_id, study, split, (63 - pos) // 3 AS pos, value FROM cells WHERE (63 - pos) % 3 = 0), s AS (SELECT study, pos, avg(value) AS m, stddev_pop(value) AS d FROM p GROUP BY ALL), o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ord FROM embeddings) SELECT o.ord, p.split, p.pos::INT AS pos, {r('(value - m) / CASE WHEN d > 1e-6 THEN d ELSE 1 END')} AS value FROM p JOIN s USING (study, pos) JOIN o ON o.vec_id = p.sample_id", "cells"))
def prepared_source(spark, d):
    """Every sample in its place, a third of the columns turned round, less the center of its study."""
    rows = I.matrix(spark, d)
    values = rows.select(F.col("sample_id").cast("string").alias("sample_id"), "values")
    own = rows.select("study", F.slice(F.reverse("values"), 1, 64).alias("values")).withColumn("values", F.filter("values", lambda x, k: k % 3 == 0))
    affine = normalize.fit_centers(own, ["study"]).select(F.col("study").cast("string").alias("domain"), "center", "scale")
    wanted = order.numbered(rows.select("sample_id", "study", "split"), [F.col("sample_id")], "ord")
    wanted = wanted.select("ord", F.col("sample_id").cast("string").alias("sample_id"), F.lit("geo").alias("kind"), "split", F.col("study").cast("string").alias("domain"), F.lit(None).cast("string").alias("donor"))
    source = Versions(spark, work_folder(spark, "prepared"))
    prepared.prepare(spark, source, wanted, NAMES, WANTED, MATRIX, affine)
    return rounded(prepared.load(source, values, MATRIX).select("ord", "split", F.posexplode("values").alias("pos", "value")))


@query(sql(f", o AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS ord FROM supplier JOIN embeddings ON s_suppkey = vec_id) SELECT method, o.ord, 's' || sample_id AS sample_id, split = 'train' AS has_outcome, ((63 - pos) // 3)::INT AS pos, {r('CASE WHEN method = $$raw$$ THEN value ELSE (value - 0.5) / 2 END')} AS value FROM cells JOIN o ON o.s_suppkey = sample_id, (VALUES ('raw'), ('standardized')) AS t(method) WHERE (63 - pos) % 3 = 0", "cells"))
def supervised_inputs(spark, d):
    """Suppliers that have a vector, by balance, for two methods whose features stand in other orders."""
    rows = I.matrix(spark, d)
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"), F.lit(".CEL"))
    own = table(spark, d, "supplier").join(rows.select(F.col("sample_id").alias("s_suppkey")), "s_suppkey")
    wanted = order.numbered(own.select("s_suppkey", "s_acctbal"), [F.col("s_acctbal").desc(), F.col("s_suppkey")], "ord").select("ord", name("s_suppkey").alias("sample_id"))
    values = rows.select(name("sample_id").alias("sample_id"), "values")
    methods = {"raw": (values, NAMES), "standardized": (values.withColumn("values", F.reverse("values")), NAMES[::-1])}
    measured = rows.filter("split = 'train'").select(name("sample_id").alias("sample_id"))
    found = prepared.supervised(spark, wanted, methods, WANTED, {"standardized": ([0.5] * len(WANTED), [2.0] * len(WANTED))}, measured)
    return rounded(found.select("method", "ord", "sample_id", "has_outcome", F.posexplode("values").alias("pos", "value")))


@query(sql(f" SELECT pos::INT AS pos, count(*) AS n, {r('sum(value)')} AS total FROM cells GROUP BY pos", "cells"))
def unit_sums(spark, d):
    """Sums over samples that come in batches which overlap, and one of which comes twice."""
    rows = I.matrix(spark, d).select(F.col("sample_id").cast("string").alias("unit"), "values", "study")
    own = Accumulation(spark, work_folder(spark, "sums"), {"values": "embedding"})
    for number, some in enumerate((F.col("study") < 4, F.col("study") < 7, F.col("study") >= 3)):
        own.add(rows.filter(some).select("unit", "values"), number)
    own.add(rows.select("unit", "values"), 2)
    found = own.totals()
    total = spark.createDataFrame([(found["n"], found["sums"])], "n bigint, sums array<double>")
    return rounded(total.select("n", F.posexplode("sums").alias("pos", "total")))

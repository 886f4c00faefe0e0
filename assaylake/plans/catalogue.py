"""All queries of the library's own operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.functions import ids, vectors
from assaylake.operators import contracts, models, normalize, outcomes, qc, reports, splits, store
from assaylake.operators import history as histories
from assaylake.plans import inputs as I
from assaylake.plans.inputs import sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a stated number of digits: sums of doubles depend on their order."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


# --- normalization


@query(sql(f", s AS (SELECT study, pos, avg(value) AS m, stddev_pop(value) AS d FROM cells GROUP BY ALL) SELECT sample_id, c.study, c.pos::INT AS pos, {r('(value - m) / CASE WHEN d > 1e-6 THEN d ELSE 1 END')} AS value FROM cells c JOIN s USING (study, pos)", "cells"))
def std_per_dataset(spark, d):
    rows = I.matrix(spark, d)
    return rounded(normalize.long_form(normalize.standardize(rows, normalize.fit_centers(rows, ["study"]), ["study"]), "sample_id", "study"))


@query(sql(f", s AS (SELECT pos, avg(value) AS m, stddev_pop(value) AS d FROM cells WHERE split = 'train' GROUP BY ALL) SELECT sample_id, split, c.pos::INT AS pos, {r('(value - m) / CASE WHEN d > 1e-6 THEN d ELSE 1 END')} AS value FROM cells c JOIN s USING (pos)", "cells"))
def std_train_only_apply_all(spark, d):
    rows = I.matrix(spark, d)
    return rounded(normalize.long_form(normalize.standardize(rows, normalize.fit_centers(rows.filter("split = 'train'"), []), []), "sample_id", "split"))


@query(sql(f", k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value, pos) - 1 AS rank FROM raw WHERE split = 'train') SELECT rank::INT AS rank, {r('avg(value)')} AS target FROM k GROUP BY rank", "raw"))
def quantile_reference_fit(spark, d):
    return rounded(normalize.quantile_reference(I.raw_matrix(spark, d).filter("split = 'train'")))


@query(sql(f", k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value, pos) - 1 AS rank FROM raw), t AS (SELECT rank, avg(value) AS target FROM k WHERE split = 'train' GROUP BY rank) SELECT sample_id, pos::INT AS pos, {r('log2(avg(target) OVER (PARTITION BY sample_id, value))')} AS mapped FROM k JOIN t USING (rank)", "raw"))
def quantile_reference_apply(spark, d):
    rows = I.raw_matrix(spark, d)
    mapped = normalize.apply_reference(rows, normalize.quantile_reference(rows.filter("split = 'train'")), "sample_id")
    return rounded(mapped.select("sample_id", F.posexplode("values").alias("pos", "mapped")))


@query(sql(f" SELECT sample_id, pos // 8 AS probe_set, {r('quantile_cont(value, 0.5)')} AS median FROM raw GROUP BY ALL", "raw"))
def probe_set_median(spark, d):
    cells = normalize.long_form(I.raw_matrix(spark, d), "sample_id").withColumn("probe_set", F.floor(F.col("pos") / 8))
    return rounded(normalize.probe_set_medians(cells, ["sample_id", "probe_set"]))


@query(sql(f", e AS (SELECT pos, quantile_cont(log2(value), 0.5) AS effect FROM raw WHERE split = 'train' GROUP BY pos) SELECT sample_id, pos // 8 AS probe_set, {r('quantile_cont(log2(value) - effect, 0.5)')} AS summary FROM raw JOIN e USING (pos) GROUP BY ALL", "raw"))
def frozen_effect_apply(spark, d):
    cells = normalize.long_form(I.raw_matrix(spark, d), "sample_id", "split").withColumn("probe_set", F.floor(F.col("pos") / 8))
    effects = cells.filter("split = 'train'").groupBy("pos").agg(F.percentile(F.log2("value"), F.lit(0.5)).alias("effect"))
    return rounded(normalize.apply_frozen_effects(cells, effects, ["pos"], ["sample_id", "probe_set"]))


@query(sql(f" SELECT count(*) AS n, {r('max(abs(value - log2(pow(2.0, value) + 0.001)))')} AS max_abs, {r('avg(abs(value - log2(pow(2.0, value) + 0.001)))')} AS mean_abs, {r('sqrt(avg(pow(value - log2(pow(2.0, value) + 0.001), 2)))')} AS rmse FROM cells", "cells"))
def matrix_delta_report(spark, d):
    a = normalize.long_form(I.matrix(spark, d), "sample_id")
    b = normalize.long_form(I.raw_matrix(spark, d), "sample_id").withColumn("value", F.log2(F.col("value") + 0.001))
    return rounded(normalize.delta_report(a, b, ["sample_id", "pos"]))


_FOLDS = "f AS (SELECT p.patient, (p.donor % 5) AS fold_of, f.fold, p.donor % 5 <> f.fold AS is_train, w.feature, w.value FROM pat p CROSS JOIN (SELECT unnest(range(0, 5)) AS fold) f JOIN (SELECT patient, 'egfr_7d' AS feature, egfr_7d AS value FROM wide UNION ALL SELECT patient, 'egfr_3m', egfr_3m FROM wide) w ON w.patient = p.patient)"


@query(sql(f", {_FOLDS}, m AS (SELECT fold, feature, quantile_cont(value, 0.5) AS med FROM f WHERE is_train GROUP BY ALL), g AS (SELECT f.* REPLACE (coalesce(value, med) AS value) FROM f JOIN m USING (fold, feature)), s AS (SELECT fold, feature, avg(value) AS mu, stddev_pop(value) AS sd FROM g WHERE is_train GROUP BY ALL) SELECT patient, fold, feature, is_train, {r('(value - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END')} AS value FROM g JOIN s USING (fold, feature)", "wide"))
def fold_impute_standardize(spark, d):
    wide = I.outcomes_wide(spark, d)
    long = wide.unpivot(["patient", "donor"], ["egfr_7d", "egfr_3m"], "feature", "value")
    rows = long.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("fold", F.col("fold").cast("bigint"))
    rows = rows.withColumn("is_train", F.pmod("donor", F.lit(5)) != F.col("fold")).drop("donor")
    return rounded(normalize.impute_and_scale(rows, ["fold"])).select("patient", "fold", "feature", "is_train", "value")


# --- quality control


@query(sql(f" SELECT sample_id, count(*) FILTER (isnan(value)) ::INT AS n_nan, count(*) FILTER (isinf(value))::INT AS n_inf, count(*) FILTER (value = 0)::INT AS n_zero, count(*) FILTER (value <= 0)::INT AS n_nonpositive, count(*)::INT AS n_finite, {r('min(value)')} AS low, {r('max(value)')} AS high, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS sd, min(value) = max(value) AS constant, min(value) = 0 AND max(value) = 0 AS all_zero, {r('sum(value)')} AS total FROM cells GROUP BY sample_id", "cells"))
def matrix_scan_rows(spark, d):
    return rounded(qc.scan_rows(I.matrix(spark, d), "sample_id"))


@query(sql(f" SELECT pos::INT AS pos, {r('min(value)')} AS low, {r('max(value)')} AS high, {r('avg(value)')} AS mean, min(value) = max(value) AS constant, min(value) = 0 AND max(value) = 0 AS all_zero, 0::BIGINT AS n_not_finite FROM cells GROUP BY pos", "cells"))
def matrix_scan_features(spark, d):
    return rounded(qc.scan_features(I.matrix(spark, d)))


@query(sql(f", s AS (SELECT split, sample_id, avg(value) AS mean, stddev_pop(value) AS sd FROM cells GROUP BY ALL) SELECT split, count(*) AS n, {r('avg(mean)')} AS mean, {r('min(mean)')} AS low, {r('max(mean)')} AS high, {r('avg(sd)')} AS sd FROM s GROUP BY split", "cells"))
def split_distribution(spark, d):
    rows = I.matrix(spark, d)
    scan = qc.scan_rows(rows, "sample_id").join(rows.select("sample_id", "split"), "sample_id")
    return rounded(scan.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean"), F.min("mean").alias("low"), F.max("mean").alias("high"), F.avg("sd").alias("sd")))


_Q = ", ".join(f"{r(f'quantile_cont(value, {q})')} AS {n}" for n, q in (("q01", 0.01), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q99", 0.99)))


@query(sql(f" SELECT study, {_Q}, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS sd, count(*) AS n FROM cells GROUP BY study", "cells"))
def scope_quantiles(spark, d):
    return rounded(qc.scope_summary(normalize.long_form(I.matrix(spark, d), "study"), ["study"]))


@query(sql(f", e AS (SELECT study, quantile_cont(value, 0.002) AS lo, quantile_cont(value, 0.998) AS hi FROM cells GROUP BY study), b AS (SELECT study, least(39, floor((value - lo) / ((hi - lo) / 40)))::INT AS bin, (hi - lo) / 40 AS w FROM cells JOIN e USING (study) WHERE value BETWEEN lo AND hi), n AS (SELECT study, bin, w, count(*) AS n FROM b GROUP BY ALL) SELECT study, bin, n, {r('n / (sum(n) OVER (PARTITION BY study) * w)')} AS density FROM n", "cells"))
def scope_histogram(spark, d):
    return rounded(qc.histogram(normalize.long_form(I.matrix(spark, d), "study"), ["study"], 0.002, 0.998, 40))


@query(sql(f", q AS (SELECT sample_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM cells GROUP BY ALL) SELECT sample_id, {r('q1')} AS q1, {r('q2')} AS q2, {r('q3')} AS q3, {r('min(value)')} AS low, {r('max(value)')} AS high FROM cells JOIN q USING (sample_id) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY sample_id, q1, q2, q3", "cells"))
def box_stats(spark, d):
    return rounded(qc.box(normalize.long_form(I.matrix(spark, d), "sample_id"), ["sample_id"]))


@query(sql(f", u AS (SELECT 'sample' AS side, value FROM cells WHERE split = 'test' UNION ALL SELECT 'reference', value FROM cells), e AS (SELECT min(a) AS lo, max(b) AS hi FROM (SELECT quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM u GROUP BY side)), b AS (SELECT side, least(69, floor((value - lo) / ((hi - lo) / 70)))::INT AS bin, (hi - lo) / 70 AS w FROM u, e WHERE value BETWEEN lo AND hi), n AS (SELECT side, bin, w, count(*) AS n FROM b GROUP BY ALL) SELECT side, bin, n, {r('n / (sum(n) OVER (PARTITION BY side) * w)')} AS density FROM n", "cells"))
def shared_bin_densities(spark, d):
    rows = normalize.long_form(I.matrix(spark, d), "split")
    return rounded(qc.shared_bins(rows.filter("split = 'test'"), rows))


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT DISTINCT CASE WHEN i = 23 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 23.0))::BIGINT END AS pos FROM n, (SELECT unnest(range(0, 24)) AS i)")
def deterministic_positions(spark, d):
    n = I.matrix(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.explode(qc.positions(F.col("n"), 24)).alias("pos"))


@query(f"WITH j AS (SELECT l.quality, l.toxic, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT 'quality' AS column_name, {r('avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) * 100')} AS percent FROM j UNION ALL SELECT 'toxic', {r('avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0.0 END) * 100')} FROM j UNION ALL SELECT 'lang', {r('avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) * 100')} FROM j")
def clinical_missingness(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(qc.missingness(rows, ["quality", "toxic", "lang"]))


@query("SELECT coalesce(source, 'Missing') AS category, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, category LIMIT 25")
def category_counts(spark, d):
    return qc.categories(table(spark, d, "documents"), "source")


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def first_occurrence(spark, d):
    return rounded(qc.first_of_each(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey"), 2)


# --- stores and catalogs


@query(sql(", m AS (SELECT sample, count(*) AS n, min(study) AS canonical FROM occ GROUP BY sample) SELECT 'GSE' || study AS study, count(*) AS memberships, count(DISTINCT occ.sample) AS samples, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS shared, count(DISTINCT canonical) AS canonical_studies, row_number() OVER (ORDER BY study) - 1 AS position FROM occ JOIN m ON m.sample = occ.sample GROUP BY study", "occ"))
def dataset_catalog(spark, d):
    """Studies in natural order, with the studies that their samples count under."""
    occ = I.occurrences(spark, d)
    canonical = occ.groupBy("sample").agg(F.min("study").alias("canonical"))
    name = F.concat(F.lit("GSE"), F.col("study").cast("string"))
    return store.catalog(occ.join(canonical, "sample").withColumn("study", name))


@query(sql(", o AS (SELECT study, row_number() OVER (ORDER BY study, sample) - 1 AS ord FROM occ) SELECT study, min(ord) AS start, max(ord) + 1 AS stop, count(*) AS n FROM o GROUP BY study", "occ"))
def row_ranges(spark, d):
    # Positions follow from the studies' sizes: a running sum over studies, not a window over all rows.
    occ = I.occurrences(spark, d)
    inside = occ.withColumn("k", F.row_number().over(W.partitionBy("study").orderBy("sample")) - 1)
    before = occ.groupBy("study").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("study").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return store.row_ranges(inside.join(before, "study").withColumn("ord", F.col("before") + F.col("k")), "study", "ord")


@query("SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
def global_row_lookup(spark, d):
    index = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return store.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), index, "o_custkey").select("o_orderkey", "o_custkey", "c_nationkey")


@query(sql(" SELECT p.p_partkey AS sample, string_agg(o.study::VARCHAR, ',' ORDER BY o.study) AS studies FROM part p LEFT JOIN occ o ON o.sample = p.p_partkey GROUP BY p.p_partkey", "occ").replace("SELECT p.p_partkey AS sample, string_agg", "SELECT p.p_partkey AS sample, string_agg"))
def sample_provenance(spark, d):
    occ = I.occurrences(spark, d)
    return store.provenance(table(spark, d, "part").select(F.col("p_partkey").alias("sample")), occ).withColumn("studies", F.when(F.col("studies") != "", F.col("studies")))


@query(sql(f" SELECT sample_id, {r('max(value) FILTER (pos = 63)')} AS a, {r('max(value) FILTER (pos = 0)')} AS b, {r('max(value) FILTER (pos = 31)')} AS c FROM cells GROUP BY sample_id", "cells"))
def probe_alignment(spark, d):
    rows = store.gather_columns(I.matrix(spark, d), store.probe_map([f"p{k}" for k in range(64)], ["p63", "p0", "p31"]))
    return rounded(rows.select("sample_id", *(F.get("values", F.lit(k)).alias(n) for k, n in enumerate("abc"))))


@query("WITH p AS (SELECT vec_id, label, vec_id AS ord FROM embeddings WHERE label < 5), s AS (SELECT vec_id, label, vec_id AS ord FROM embeddings WHERE label >= 5) SELECT vec_id AS sample_id, ord FROM p UNION ALL SELECT vec_id, ord + (SELECT max(ord) + 1 FROM p) FROM s")
def union_source(spark, d):
    rows = I.matrix(spark, d).select("sample_id", "ord", "study")
    return store.union_source(rows.filter("study < 5"), rows.filter("study >= 5")).select("sample_id", "ord")


@query("SELECT vec_id AS sample_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, len(embedding)::INT AS n FROM embeddings ORDER BY vec_id LIMIT 8")
def view_preview(spark, d):
    rows = store.preview(I.matrix(spark, d).withColumn("n", F.size("values")))
    return rounded(rows.select("sample_id", F.get("values", F.lit(0)).alias("first"), "n"))


# --- splits


@query(sql(", RECURSIVE e AS (SELECT DISTINCT a.study AS u, b.study AS v FROM occ a JOIN occ b ON a.sample = b.sample), r AS (SELECT u, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u WHERE r.c < e.v) SELECT u AS study, min(c) AS component FROM r GROUP BY u", "occ"))
def study_components(spark, d):
    from assaylake.session import work_folder

    return splits.study_components(spark, I.occurrences(spark, d), work_folder(spark, "components"))


@query("WITH m AS (SELECT c_custkey // 2 AS donor, c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS measured FROM customer) SELECT c_custkey AS patient, donor, measured, CASE WHEN measured THEN 'held_out' WHEN bool_or(measured) OVER (PARTITION BY donor) THEN 'related' ELSE 'eligible' END AS role FROM m")
def donor_roles(spark, d):
    measured = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("patient"), F.lit(True).alias("measured")).distinct()
    rows = I.patients(spark, d).select("patient", "donor").join(measured, "patient", "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    return splits.roles(rows).select("patient", "donor", "measured", "role")


@query("WITH d AS (SELECT c_custkey AS donor, c_mktsegment AS stratum, (c_custkey * 2654435761 + (20260915 % 100000)::BIGINT * 1013904223) % 2147483647 AS score FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score, donor) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM d) SELECT donor, stratum, score, CASE WHEN n >= 2 AND k <= least(greatest(round_even(n * 0.2, 0)::BIGINT, 1), n - 1) THEN 'validation' ELSE 'train' END AS split FROM k")
def donor_split(spark, d):
    return splits.donor_split(I.patients(spark, d).select(F.col("patient").alias("donor"), F.col("patient").alias("number"), "stratum"), 20260915, 0.2)


@query(sql(f" SELECT split, count(DISTINCT sample_id) AS samples, {r('100.0 * count(DISTINCT sample_id) / (SELECT count(DISTINCT sample_id) FROM cells)')} AS percent, count(DISTINCT study) AS groups, count(DISTINCT CASE WHEN sample_id % 9 = 0 THEN sample_id END) AS supervised FROM cells GROUP BY split", "cells"))
def split_summary(spark, d):
    rows = I.matrix(spark, d).select(F.col("sample_id").alias("sample"), F.col("study").alias("group"), "split", (F.col("sample_id") % 9 == 0).alias("supervised"))
    return rounded(splits.summary(rows))


@query(f"WITH d AS (SELECT DISTINCT c_custkey // 2 AS donor, CASE WHEN (c_custkey // 2) % 7 < 3 THEN 'a' WHEN (c_custkey // 2) % 7 < 6 THEN 'b' ELSE 'c' END AS stratum FROM customer), c AS (SELECT stratum, coalesce(sum(count(*)) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d GROUP BY stratum), k AS (SELECT repeat, donor, stratum, row_number() OVER (PARTITION BY repeat, stratum ORDER BY ('0x' || substr(md5((11 + repeat)::VARCHAR || ':' || donor::VARCHAR), 1, 13))::BIGINT, donor) - 1 AS rank FROM d, (SELECT unnest(range(1, 4)) AS repeat)) SELECT repeat::INT AS repeat, donor, ((before + rank + ('0x' || substr(md5((11 + repeat)::VARCHAR || ':' || repeat::VARCHAR), 1, 13))::BIGINT) % 4 + 1)::INT AS fold FROM k JOIN c USING (stratum)")
def stratified_folds(spark, d):
    donors = I.patients(spark, d).select("donor").distinct()
    stratum = F.when(F.col("donor") % 7 < 3, "a").when(F.col("donor") % 7 < 6, "b").otherwise("c")
    return splits.stratified_folds_of(donors.withColumn("stratum", stratum), 4, 3, 11)


@query()
def split_apply(spark, d):
    from assaylake.session import work_folder

    samples = I.matrix(spark, d).select(F.col("sample_id").alias("sample"), "study")
    return splits.component_split(spark, samples, splits.study_components(spark, samples, work_folder(spark, "split")), 5, 0.8, 0.1)


@query("SELECT l_partkey AS sample, count(DISTINCT l_suppkey % 3) AS parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 3) > 1")
def split_leak_check(spark, d):
    return contracts.crossing(I.occurrences(spark, d).withColumn("part", F.pmod("study", F.lit(3))), "sample", "part")


@query(sql(", q AS (SELECT [quantile_cont(kdri, 0.0), quantile_cont(kdri, 0.25), quantile_cont(kdri, 0.5), quantile_cont(kdri, 0.75), quantile_cont(kdri, 1.0)] AS e, quantile_cont(kdri, 0.5) AS m FROM pat) SELECT patient, greatest(len(list_filter(list_distinct(e), lambda x: x < coalesce(kdri, m))) - 1, 0)::INT AS stratum_no FROM pat, q", "pat"))
def qcut_strata(spark, d):
    return splits.quantile_strata(I.patients(spark, d).select("patient", "kdri"), "kdri").select("patient", F.col("stratum").alias("stratum_no"))


@query("SELECT count(*) AS n, min(array_index) AS lo, max(array_index) AS hi, count(DISTINCT settings) AS settings FROM (SELECT row_number() OVER () AS array_index, a || '/' || b || '/' || c AS settings FROM (SELECT unnest([32, 64, 128]) AS a), (SELECT unnest(['mse', 'huber', 'vae', 'mmd', 'masked']) AS b), (SELECT unnest([1, 2, 3, 4]) AS c) UNION ALL SELECT 60 + row_number() OVER (), 'x' || a FROM (SELECT unnest([0.1, 0.2]) AS a))")
def sweep_expand(spark, d):
    fields = {"latent", "loss", "seed", "rate"}
    runs = splits.expand_sweep(spark, {"main": {"grid": {"latent": [32, 64, 128], "loss": ["mse", "huber", "vae", "mmd", "masked"], "seed": [1, 2, 3, 4]}}, "rate": {"fixed": {"latent": 8}, "grid": {"rate": [0.1, 0.2]}}}, fields)
    return runs.agg(F.count(F.lit(1)).alias("n"), F.min("array_index").alias("lo"), F.max("array_index").alias("hi"), F.countDistinct("settings").alias("settings"))


_ORDER = "('0x' || substr(md5(({})::VARCHAR || ':' || donor), 1, 13))::BIGINT"
_NESTED = f"""nd AS (SELECT DISTINCT (c_custkey // 2)::VARCHAR AS donor FROM customer), nn AS (SELECT count(*) AS n FROM nd),
 nr AS (SELECT repeat, donor, row_number() OVER (PARTITION BY repeat ORDER BY {_ORDER.format('7 + repeat')}, donor) - 1 AS k, n // 3 AS size, n % 3 AS more, n FROM nd, nn, (SELECT unnest(range(0, 2)) AS repeat)),
 no AS (SELECT *, CASE WHEN k < more * (size + 1) THEN k // (size + 1) ELSE more + (k - more * (size + 1)) // size END AS own FROM nr),
 nf AS (SELECT *, row_number() OVER (PARTITION BY repeat, fold, own <> fold ORDER BY {_ORDER.format('100010 + 1009 * repeat + 37 * fold')}, donor) - 1 AS j FROM no, (SELECT unnest(range(0, 3)) AS fold)),
 nm AS (SELECT repeat::INT AS repeat, fold::INT AS fold, donor, CASE WHEN own = fold THEN 'outer_test' ELSE 'outer_train' END AS outer_role, CASE WHEN own = fold THEN 'not_applicable' WHEN j < ceil((n - size - CASE WHEN fold < more THEN 1 ELSE 0 END) / 2) THEN 'inner_validation' ELSE 'inner_train' END AS inner_role FROM nf)"""


@query(f"WITH {_NESTED} SELECT * FROM nm")
def nested_manifest(spark, d):
    """Roles of every donor of the cohort in every fold."""
    return splits.nested_manifest_of(I.patients(spark, d), 3, 2, 2, 7)


@query(f"WITH {_NESTED}, f AS (SELECT * FROM nm WHERE NOT (outer_role = 'outer_test' AND donor::BIGINT % 5 = 1) UNION ALL SELECT repeat, fold, donor, outer_role, 'inner_train' FROM nm WHERE outer_role = 'outer_test' AND donor::BIGINT % 5 = 1 UNION ALL SELECT repeat, fold, donor, 'outer_test', 'not_applicable' FROM nm WHERE outer_role = 'outer_train' AND donor::BIGINT % 7 = 2) SELECT repeat, fold, donor, count(DISTINCT outer_role || '/' || inner_role) AS roles, count(*) FILTER (outer_role = 'outer_test' AND inner_role <> 'not_applicable') AS bad FROM f GROUP BY ALL HAVING roles > 1 OR bad > 0")
def nested_manifest_check(spark, d):
    """A manifest in which some tested donors have an inner role, and some trained ones are tested too."""
    good, k = nested_manifest(spark, d), F.col("donor").cast("bigint")
    test = F.col("outer_role") == "outer_test"
    faulty = good.withColumn("inner_role", F.when(test & (k % 5 == 1), "inner_train").otherwise(F.col("inner_role")))
    twice = good.filter(~test & (k % 7 == 2)).select("repeat", "fold", "donor", F.lit("outer_test").alias("outer_role"), F.lit("not_applicable").alias("inner_role"))
    return contracts.nested_leaks(faulty.unionByName(twice))


# --- outcomes


@query(sql(f", u AS (SELECT patient, donor, '7d' AS time, 0 AS time_ord, egfr_7d AS egfr FROM wide UNION ALL SELECT patient, donor, '3m', 1, egfr_3m FROM wide UNION ALL SELECT patient, donor, '6m', 2, egfr_6m FROM wide UNION ALL SELECT patient, donor, '12m', 3, egfr_12m FROM wide) SELECT patient, donor, {r('egfr', 4)} AS egfr, time, time_ord FROM u WHERE egfr IS NOT NULL", "wide"))
def outcome_wide_to_long(spark, d):
    return rounded(outcomes.wide_to_long(I.outcomes_wide(spark, d)), 4)


@query(sql(" SELECT patient, coalesce(egfr_7d, egfr_3m, egfr_6m, egfr_12m) IS NOT NULL AS measured FROM wide", "wide"))
def outcome_any_finite(spark, d):
    return I.outcomes_wide(spark, d).select("patient", outcomes.any_measured(["egfr_7d", "egfr_3m", "egfr_6m", "egfr_12m"]).alias("measured"))


@query(sql(" SELECT (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_acctbal > 0) AS n_samples, (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS clinical_matched, (SELECT count(DISTINCT patient) FROM wide WHERE patient IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS outcome_matched, (SELECT count(DISTINCT patient) FROM wide WHERE coalesce(egfr_7d, egfr_3m, egfr_6m, egfr_12m) IS NOT NULL AND patient IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS outcome_valid_matched", "wide"))
def outcome_match_summary(spark, d):
    samples = I.patients(spark, d).filter("kdri > 0").select("patient")
    return outcomes.match_summary(samples, table(spark, d, "supplier").select(F.col("s_suppkey").alias("patient")), I.outcomes_wide(spark, d), ["egfr_7d", "egfr_3m", "egfr_6m", "egfr_12m"], "patient")


@query(sql(f" SELECT ['7d','3m','6m','12m'][time_ord + 1] AS time, time_ord, {r('quantile_cont(egfr, 0.5)', 4)} AS median, count(*) AS n FROM long l JOIN pat USING (patient) GROUP BY time_ord", "pat", "long"))
def trajectory_median(spark, d):
    return rounded(outcomes.trajectory(outcomes.wide_to_long(I.outcomes_wide(spark, d))), 4)


@query(sql(f", s AS (SELECT patient, count(egfr) AS n, sum(egfr) AS t FROM long GROUP BY patient) SELECT l.patient, time_ord, {r('egfr + (1 / sqrt(1 + 0.5 * n) - 1) / n * t', 3)} AS egfr_white, [1.0, (time_ord = 1)::INT::DOUBLE, (time_ord = 2)::INT::DOUBLE, (time_ord = 3)::INT::DOUBLE][3] AS third FROM long l JOIN s ON s.patient = l.patient", "long"))
def time_design_whitening(spark, d):
    rows = outcomes.whiten(I.outcomes_long(spark, d), "patient", "egfr", 0.5)
    return rounded(rows.select("patient", "time_ord", "egfr_white", F.get(outcomes.time_design(F.col("time_ord")), F.lit(2)).alias("third")), 3)


@query(sql(f" SELECT c AS variable, {r('quantile_cont(v, 0.5)')} AS median, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS sd FROM (SELECT 'kdri' AS c, kdri AS v FROM pat UNION ALL SELECT 'donor', donor::DOUBLE FROM pat) GROUP BY c", "pat"))
def clinical_geometry(spark, d):
    return rounded(outcomes.clinical_geometry(I.patients(spark, d), ["kdri", "donor"]))


@query(sql(f", s AS (SELECT n_nationkey AS k, avg(c_acctbal) AS a, avg(c_custkey) AS b FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT {r('quantile_cont(d, 0.5)')} AS bandwidth FROM (SELECT sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d FROM s x JOIN s y ON x.k < y.k) WHERE d > 0", "pat"))
def clinical_bandwidth(spark, d):
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array(F.avg("c_acctbal"), F.avg("c_custkey")).alias("v"))
    return rounded(outcomes.bandwidth(rows, "k", "v"))


@query("SELECT c_custkey // 2 AS donor, string_agg(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'P' END, '' ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'P' END) AS pattern FROM customer GROUP BY 1")
def donor_tissue_pattern(spark, d):
    return outcomes.tissue_pattern(I.patients(spark, d).select("donor", F.when(F.pmod("patient", F.lit(2)) == 0, "L").otherwise("P").alias("tissue")))


@query("SELECT o.ord, s.seg AS c_mktsegment, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1, 2])::INT AS ord, unnest(['BUILDING', 'NOT THERE', 'MACHINERY']) AS seg) s JOIN (SELECT unnest([0, 1, 2])::INT AS ord) o ON o.ord = s.ord LEFT JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) c ON c.c_mktsegment = s.seg")
def outcome_group_counts(spark, d):
    return outcomes.group_counts(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "NOT THERE", "MACHINERY"])


@query(sql(f" SELECT f.fold, p.donor % 5 <> f.fold AS is_train, l.patient, time_ord, {r('egfr', 4)} AS egfr, {r('kdri', 4)} AS kdri FROM pat p CROSS JOIN (SELECT unnest(range(0, 5)) AS fold) f JOIN long l ON l.patient = p.patient", "pat", "long"))
def fold_design(spark, d):
    people = I.patients(spark, d)
    folds = people.select("patient", "donor", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("fold"))
    folds = folds.select("patient", "fold", (F.pmod("donor", F.lit(5)) != F.col("fold")).alias("is_train"))
    return rounded(outcomes.fold_design(folds, I.outcomes_long(spark, d), people.select("patient", "kdri")).select("fold", "is_train", "patient", "time_ord", "egfr", "kdri"), 4)


# --- reports


_DELTA = ", b AS (SELECT repeat, fold, rmse AS base FROM met WHERE model_id = 'NO'), d AS (SELECT met.*, base - rmse AS delta FROM met JOIN b USING (repeat, fold))"


@query(sql(f"{_DELTA} SELECT model_id, repeat, fold, {r('rmse')} AS rmse, {r('delta')} AS delta FROM d", "met"))
def delta_vs_time(spark, d):
    return rounded(reports.delta_to(I.metrics(spark, d), "NO", ["repeat", "fold"]).select("model_id", "repeat", "fold", "rmse", "delta"))


@query(sql(f"{_DELTA}, s AS (SELECT model_id, avg(rmse) AS mean_rmse, stddev_samp(rmse) AS sd_rmse, avg(delta) AS mean_delta, stddev_samp(delta) AS sd_delta, avg((delta > 0)::INT) AS better_fraction, count(*) AS n_folds FROM d GROUP BY model_id), e AS (SELECT *, sd_delta / sqrt(n_folds) AS se FROM s) SELECT model_id, {r('mean_rmse')} AS mean_rmse, {r('sd_rmse')} AS sd_rmse, {r('mean_delta')} AS mean_delta, {r('sd_delta')} AS sd_delta, {r('better_fraction')} AS better_fraction, n_folds, {r('se')} AS se, {r('mean_delta - 1.96 * se')} AS ci_low, {r('mean_delta + 1.96 * se')} AS ci_high, {r('mean_delta - se')} AS lower_bound FROM e", "met"))
def report_summary_ci(spark, d):
    return rounded(reports.summarize(reports.delta_to(I.metrics(spark, d), "NO", ["repeat", "fold"]), ["model_id"]))


@query(sql(f" SELECT model_id, {r('sqrt(avg((y - p) * (y - p)))')} AS pooled_rmse FROM pred GROUP BY model_id", "pred"))
def pooled_rmse(spark, d):
    return rounded(reports.pooled_rmse(I.predictions(spark, d), ["model_id"]))


@query(sql(f", e AS (SELECT model_id, donor, avg((y - p) * (y - p)) AS e FROM pred GROUP BY ALL) SELECT model_id, {r('sqrt(avg(e))')} AS donor_rmse, {r('stddev_samp(e)')} AS sd_over_donors FROM e GROUP BY model_id", "pred"))
def donor_balanced_rmse(spark, d):
    return rounded(reports.donor_balanced_rmse(I.predictions(spark, d), ["model_id"], "donor"))


@query(sql(f", w AS (SELECT repeat, fold, rmse AS w FROM met WHERE model_id = 'AF') SELECT model_id, {r('avg(rmse - w)')} AS mean_gain, {r('avg((w < rmse)::INT)')} AS better_fraction, count(*) AS n FROM met LEFT JOIN w USING (repeat, fold) WHERE model_id <> 'AF' GROUP BY model_id", "met"))
def winner_gain(spark, d):
    return rounded(reports.against_winner(I.metrics(spark, d), "AF", ["repeat", "fold"]))


@query(sql(f" SELECT a.repeat, a.fold, {r('a.rmse')} AS rmse, {r('b.rmse')} AS other_rmse, {r('b.rmse - a.rmse')} AS gain FROM met a JOIN met b ON a.repeat = b.repeat AND a.fold = b.fold WHERE a.model_id = 'AF' AND b.model_id = 'RF'", "met"))
def incremental_gain(spark, d):
    return rounded(reports.matched(I.metrics(spark, d), "AF", "RF", ["repeat", "fold"]))


@query(sql(f", k AS (SELECT *, row_number() OVER (PARTITION BY repeat, fold ORDER BY rmse, model_id) AS k FROM met) SELECT repeat, fold, {r('rmse')} AS rmse, model_id FROM k WHERE k = 1", "met"))
def group_winners(spark, d):
    return rounded(reports.best_of(I.metrics(spark, d), ["repeat", "fold"], ["rmse", "model_id"]))


@query(sql(f", k AS (SELECT model_id, repeat, avg(rmse) AS mean_inner, count(*) AS n FROM met GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY mean_inner, model_id) AS k FROM k) SELECT repeat, {r('mean_inner')} AS mean_inner, model_id, n FROM w WHERE k = 1", "met"))
def inner_selection(spark, d):
    inner = I.metrics(spark, d).groupBy("model_id", "repeat").agg(F.avg("rmse").alias("mean_inner"), F.count(F.lit(1)).alias("n"))
    return rounded(reports.best_of(inner, ["repeat"], ["mean_inner", "model_id"]))


@query(sql(f", s AS (SELECT model_id, count(*) AS selected FROM (SELECT *, row_number() OVER (PARTITION BY repeat, fold ORDER BY rmse, model_id) AS k FROM met) WHERE k = 1 GROUP BY 1) SELECT met.model_id, {r('avg(rmse)')} AS mean_rmse, {r('stddev_samp(rmse)')} AS sd_rmse, count(*) AS n, coalesce(max(selected), 0) AS selected, {r('coalesce(max(selected), 0) / (SELECT sum(selected) FROM s)')} AS selected_fraction FROM met LEFT JOIN s ON s.model_id = met.model_id GROUP BY met.model_id", "met"))
def deployment_ranking(spark, d):
    m = I.metrics(spark, d)
    return rounded(reports.ranking(m, reports.best_of(m, ["repeat", "fold"], ["rmse", "model_id"])))


@query("SELECT CASE WHEN c.k IS NULL THEN 'right_only' WHEN s.k IS NULL THEN 'left_only' ELSE 'both' END AS side, coalesce(abs(c.v - s.v) <= 1000, false) AS close, count(*) AS n FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) c FULL OUTER JOIN (SELECT s_suppkey * 2 AS k, s_acctbal AS v FROM supplier) s ON s.k = c.k GROUP BY 1, 2")
def outer_indicator(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_acctbal").alias("v"))
    return reports.reconcile(a, b, ["k"], "v", 1000).groupBy("side", "close").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT c_custkey + 50 AS k FROM customer), s AS (SELECT s_suppkey AS k FROM supplier), a AS (SELECT k::VARCHAR AS x, row_number() OVER (ORDER BY k) AS i FROM c WHERE k NOT IN (SELECT k FROM s)), b AS (SELECT k::VARCHAR AS x, row_number() OVER (ORDER BY k) AS i FROM s WHERE k NOT IN (SELECT k FROM c)) SELECT coalesce(a.i, b.i)::INT AS row, coalesce(a.x, '') AS clinical, coalesce(b.x, '') AS outcome FROM a FULL OUTER JOIN b ON a.i = b.i")
def unmatched_report(spark, d):
    return reports.unmatched({"clinical": table(spark, d, "customer").select((F.col("c_custkey") + 50).alias("k")), "outcome": table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))}, "k")


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT -1 - s_suppkey, s_acctbal, NULL FROM supplier")
def union_missing_columns(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return reports.disjoint_union(a, table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("balance")), "id")


# --- histories


@query(sql(f", h AS (SELECT run, epoch, CASE WHEN run % 5 <> 0 OR epoch % 3 <> 0 THEN score END AS score, score * score AS loss FROM hist), w AS (SELECT run, count(score) = count(loss) AS whole FROM h GROUP BY run), v AS (SELECT run, epoch, CASE WHEN whole THEN score ELSE loss END AS score FROM h JOIN w USING (run)), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score, epoch) AS k FROM v WHERE score IS NOT NULL) SELECT run, epoch, {r('score')} AS score FROM k WHERE k = 1", "hist"))
def history_best_epoch(spark, d):
    """Runs whose scores have gaps are judged by their loss."""
    rows = I.history(spark, d).withColumn("loss", F.col("score") * F.col("score"))
    return rounded(histories.best_epoch(rows.withColumn("score", F.when((F.col("run") % 5 != 0) | (F.col("epoch") % 3 != 0), F.col("score"))), "loss"))


@query(sql(f", c AS (SELECT run, epoch, abs(score - lag(score) OVER w) / greatest(abs(lag(score) OVER w), 1e-12) AS change, greatest(0.002, 0.01 * pow(0.5, epoch)) AS rate FROM hist WINDOW w AS (PARTITION BY run ORDER BY epoch)) SELECT run, epoch, coalesce(count(change) OVER v = 2 AND max(change) OVER v <= 0.9, false) AND rate <= 0.002 * (1 + 1e-6) + 1e-15 AS converged FROM c WINDOW v AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", "hist"))
def history_converged_at_floor(spark, d):
    rows = I.history(spark, d).withColumn("rate", F.greatest(F.lit(0.002), F.lit(0.01) * F.pow(F.lit(0.5), F.col("epoch"))))
    return histories.convergence(rows, 2, 0.9, "rate", 0.002).select("run", "epoch", F.coalesce("converged", F.lit(False)).alias("converged"))


@query(sql(f", c AS (SELECT run, epoch, abs(score - lag(score) OVER w) / greatest(abs(lag(score) OVER w), 1e-12) AS change FROM hist WINDOW w AS (PARTITION BY run ORDER BY epoch)) SELECT run, epoch, {r('change')} AS change, coalesce(count(change) OVER v = 3 AND max(change) OVER v <= 0.5, false) AS converged FROM c WINDOW v AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "hist"))
def history_convergence(spark, d):
    return rounded(histories.convergence(I.history(spark, d), 3, 0.5).select("run", "epoch", "change", F.coalesce("converged", F.lit(False)).alias("converged")))


@query(sql(f", RECURSIVE e AS (SELECT run, epoch, score AS ema FROM hist WHERE epoch = 1 UNION ALL SELECT h.run, h.epoch, 0.9::DOUBLE * e.ema + (1 - 0.9::DOUBLE) * h.score FROM e JOIN hist h ON h.run = e.run AND h.epoch = e.epoch + 1) SELECT run, epoch, {r('ema')} AS ema FROM e", "hist"))
def history_ema(spark, d):
    return rounded(histories.moving_average(I.history(spark, d)))


@query(sql(f" SELECT run, epoch, {r('score')} AS score, {r('min(score) OVER (PARTITION BY run ORDER BY epoch)')} AS best FROM hist", "hist"))
def history_running_best(spark, d):
    return rounded(histories.running_best(I.history(spark, d)).select("run", "epoch", "score", "best"))


@query(sql(", l AS (SELECT *, max(epoch) OVER (PARTITION BY run) AS last FROM hist) SELECT run, epoch FROM l WHERE epoch = 1 OR epoch % 5 = 0 OR epoch = last", "hist"))
def history_cadence(spark, d):
    return histories.cadence(I.history(spark, d), 5).select("run", "epoch")


@query("SELECT event_id FROM (SELECT event_id, value AS a, value * 0.25 AS b, 0.5 * value + 0.125 * value + CASE WHEN event_id % 7 = 0 THEN 0.001 ELSE 0 END AS s FROM events) WHERE abs(0.5 * a + 0.5 * b - s) > 1e-12 + 1e-9 * abs(s) OR event_id % 11 = 0")
def checkpoint_consistency(spark, d):
    """Two domains; some selections are not their mean, and some declared scores not the selection."""
    k, v = F.col("event_id"), F.col("value")
    rows = table(spark, d, "events").select("event_id", v.alias("first_domain"), (v * 0.25).alias("second_domain"), (0.5 * v + 0.125 * v + F.when(k % 7 == 0, 0.001).otherwise(0.0)).alias("selection"))
    rows = rows.withColumn("declared_best", F.when(k % 11 == 0, F.col("selection") + 1).otherwise(F.col("selection")))
    return histories.inconsistent_scores(rows).select("event_id")


@query(sql(f", s AS (SELECT study AS domain, sample_id // 2 AS donor, sum((value - 0.01) * (value - 0.01)) AS sse, sum(value) AS sy, sum(value * value) AS sy2, count(*) AS n FROM cells GROUP BY study, sample_id), w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY domain, donor) AS w FROM s), t AS (SELECT domain, sum(w * sse) AS sse, sum(w * sy) AS sy, sum(w * sy2) AS sy2, sum(w * n) AS n FROM w GROUP BY domain), v AS (SELECT domain, stddev_samp(m) AS sd FROM (SELECT domain, donor, avg(sse / n) AS m FROM s GROUP BY ALL) GROUP BY domain) SELECT t.domain, {r('sse / n')} AS mse, {r('1 - sse / (sy2 - sy * sy / n)')} AS r2, {r('sd')} AS sd_over_donors FROM t JOIN v ON v.domain = t.domain", "cells"))
def weighted_clean_mse(spark, d):
    m = I.matrix(spark, d)
    guess = F.transform("values", lambda x: F.lit(0.01))
    rows = m.select(F.col("study").alias("domain"), F.floor(F.col("sample_id") / 2).alias("donor"), vectors.squared_error("values", guess).alias("sse"), vectors.total("values").alias("sum_y"), vectors.total("values", lambda x: x * x).alias("sum_y2"), F.size("values").alias("n"))
    return rounded(histories.weighted_clean_mse(rows))


@query(sql(f", g AS (SELECT sample_id, pos, value AS x, value * 0.9 + 0.01 AS y FROM cells) SELECT sample_id, {r('avg((x - y) * (x - y))')} AS mse, {r('avg(CASE WHEN abs(x - y) <= 0.02 THEN (x - y) * (x - y) / 2 ELSE 0.02 * (abs(x - y) - 0.01) END)')} AS huber, {r('sum(x * y) / greatest(sqrt(sum(x * x)) * sqrt(sum(y * y)), 1e-8)')} AS cosine, {r('-sum(exp(x) / ex * (y - ln(ey)))')} AS cross_entropy FROM (SELECT *, sum(exp(x)) OVER (PARTITION BY sample_id) AS ex, sum(exp(y)) OVER (PARTITION BY sample_id) AS ey FROM g) GROUP BY sample_id", "cells"))
def row_objectives(spark, d):
    m = I.matrix(spark, d).withColumn("guess", F.transform("values", lambda x: x * 0.9 + 0.01))
    return rounded(m.select("sample_id", (vectors.squared_error("values", "guess") / F.size("values")).alias("mse"), vectors.huber("values", "guess", 0.02).alias("huber"), vectors.cosine("values", "guess").alias("cosine"), vectors.softmax_cross_entropy("values", "guess").alias("cross_entropy")))


# --- contracts


@query("SELECT * FROM (SELECT count(*) AS n, count(DISTINCT o) AS d, min(o) AS lo, max(o) AS hi FROM (SELECT CASE WHEN vec_id % 50 = 7 THEN vec_id + 1 ELSE vec_id END AS o FROM embeddings)) WHERE d <> n OR lo <> 0 OR hi <> n - 1")
def row_permutation_check(spark, d):
    """Some places are there twice, and others not at all."""
    return contracts.not_permutation(I.matrix(spark, d).withColumn("ord", F.when(F.col("ord") % 50 == 7, F.col("ord") + 1).otherwise(F.col("ord"))), "ord")


@query("WITH p AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT * FROM p WHERE n > 1")
def duplicate_keys(spark, d):
    return contracts.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(sql(", o AS (SELECT study, row_number() OVER (ORDER BY study, sample) - 1 AS ord FROM occ), g AS (SELECT study, min(ord) AS start, max(ord) + 1 AS stop, count(*) + (study % 7 = 0)::INT AS n FROM o GROUP BY study) SELECT study, start, stop, n FROM g WHERE stop - start <> n", "occ"))
def manifest_contiguity(spark, d):
    ranges = row_ranges(spark, d).withColumn("n", F.col("n") + (F.pmod("study", F.lit(7)) == 0).cast("int"))
    total = I.occurrences(spark, d).count()
    return contracts.not_contiguous(ranges, total)


@query("(SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer) UNION ALL (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders)")
def frozen_split_difference(spark, d):
    return contracts.differing(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))).select("k")


# --- identifiers


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'S' || p_partkey || '_L' WHEN p_partkey % 3 = 1 THEN 'S' || p_partkey ELSE 'S' || p_partkey || '_P' END AS sample, CASE WHEN p_partkey % 3 = 1 THEN 'U' WHEN p_partkey % 3 = 0 THEN 'L' ELSE 'P' END AS tissue, 'S' || p_partkey AS donor FROM part")
def id_normalize(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(F.lit(" raw/S"), k.cast("string"), F.when(k % 3 == 0, "_L_(PrimeView).CEL.gz").when(k % 3 == 1, ".cel").otherwise("_P.CEL "))
    return table(spark, d, "part").select("p_partkey", ids.sample_id(raw).alias("sample"), ids.tissue(raw).alias("tissue"), ids.donor_of_biopsy(raw).alias("donor"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("SELECT c_nationkey, sha256(string_agg(k, chr(10) ORDER BY k COLLATE \"C\") || chr(10)) AS membership FROM (SELECT c_nationkey, 'GEO:' || upper(c_name) AS k FROM customer) GROUP BY 1".replace(' COLLATE "C"', ""))
def membership_hash(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(ids.membership_hash(ids.sample_key(F.lit("geo"), F.col("c_name"))).alias("membership"))


@query("SELECT doc_id, coalesce(try_cast(replace(upper(source), 'SRC', '') AS BIGINT), 1000000000000000000) AS k FROM documents")
def natural_sort_key(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.accession_number(F.col("source"), "SRC").alias("k"))


@query("SELECT o_orderkey, printf('fixed_r%03d_f%03d_', o_orderkey % 7, o_orderkey % 5) || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS fit_id FROM orders")
def fit_identifier(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.fit_id(F.pmod("o_orderkey", F.lit(7)).cast("int"), F.pmod("o_orderkey", F.lit(5)).cast("int"), F.col("o_orderpriority")).alias("fit_id"))


# --- models


@query()
def median_polish(spark, d):
    cells = normalize.long_form(I.raw_matrix(spark, d).filter("split = 'train'"), "sample_id")
    return rounded(models.median_polish(cells.select(F.floor(F.col("pos") / 8).alias("probe_set"), F.col("pos").cast("bigint").alias("cell"), F.col("sample_id").alias("sample"), F.log2("value").alias("value"))))


@query()
def pca_scores(spark, d):
    rows = I.matrix(spark, d).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    return models.pca(rows.select("fold", F.col("sample_id").alias("id"), (F.pmod("study", F.lit(3)) != F.col("fold")).alias("is_train"), F.col("values").alias("x")), 3)


def _design(spark, d):
    people = I.patients(spark, d)
    long = I.outcomes_long(spark, d).withColumn("egfr", F.col("egfr") / 1000)
    rows = people.join(long, "patient").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rows.select(F.concat(F.lit("f"), F.col("fold").cast("string")).alias("fit_id"), (F.pmod("donor", F.lit(5)) != F.col("fold")).alias("is_train"), "patient", "time_ord", "egfr", F.array(F.col("kdri") / 1000, F.pmod(F.xxhash64("patient"), F.lit(1000)) / 1000).alias("x"))


@query()
def lmm_fit(spark, d):
    return models.fit_mixed_models(_design(spark, d))


@query()
def lasso_path(spark, d):
    return models.lasso_criteria(_design(spark, d).filter("is_train").drop("is_train"))


_ENCODED = ", w AS (SELECT unnest(range(0, 8)) AS k), z AS (SELECT sample_id, k, sum((value - 0.1) * sqrt(2.0 / 64) * cos(pi() * (pos + 0.5) * (k + 1) / 64)) AS z FROM cells, w GROUP BY ALL), b AS (SELECT sample_id, pos, sum(z * sqrt(2.0 / 64) * cos(pi() * (pos + 0.5) * (k + 1) / 64)) AS back FROM z, (SELECT unnest(range(0, 64)) AS pos) GROUP BY ALL), e AS (SELECT sample_id, avg(pow(value - 0.1 - back, 2)) AS mse FROM cells JOIN b USING (sample_id, pos) GROUP BY sample_id)"


@query(sql(f"{_ENCODED} SELECT sample_id, k::INT AS k, {r('z')} AS z, {r('mse')} AS mse FROM z JOIN e USING (sample_id)", "cells"))
def encoder_embedding(spark, d):
    """A frozen linear encoder, the first cosines of a transform, and what it cannot restore."""
    found = models.encode(I.matrix(spark, d), _designs.cosines(64, 8), np.full(64, 0.1))
    return rounded(found.select("sample_id", F.posexplode("z").alias("k", "z"), "mse"))


from assaylake.plans import evaluation as _designs  # noqa: E402, F401  registers its queries
from assaylake.plans import selections as _more  # noqa: E402, F401  registers its queries
from assaylake.plans import sources as _sources  # noqa: E402, F401  registers its queries

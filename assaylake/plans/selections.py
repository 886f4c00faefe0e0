"""Queries of selections, comparisons, schedules and contracts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import ids, training
from assaylake.operators import contracts, order, selections
from assaylake.plans import inputs as I
from assaylake.plans.catalogue import query, r, rounded
from assaylake.plans.inputs import sql, table

RUNS = "SELECT s_suppkey AS run, s_nationkey AS arm, s_acctbal AS score FROM supplier"


def _runs(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), F.col("s_nationkey").alias("arm"), F.col("s_acctbal").alias("score"))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def optional_projection(spark, d):
    return selections.optional_columns(table(spark, d, "customer"), ["c_custkey", "not_there", "c_mktsegment"])


@query(f"SELECT * FROM ({RUNS}) WHERE arm < 20 AND score > 0")
def eligible_runs(spark, d):
    runs = _runs(spark, d)
    return selections.eligible(runs, runs.filter("arm < 20"), runs.filter("score > 0").unionByName(runs.filter("score > 0")))


@query("WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ord, count(*) OVER () AS n FROM embeddings), i AS (SELECT ord, (ord * ord + 3) % n AS at FROM o) SELECT o.vec_id AS sample_id, i.ord FROM i JOIN o ON o.ord = i.at")
def row_gather(spark, d):
    """As many places as there are rows, some of them more than once."""
    rows = order.numbered(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id")), [F.col("sample_id")], "ord")
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))  # one row
    index = rows.crossJoin(F.broadcast(n)).select(F.pmod(F.col("ord") * F.col("ord") + 3, F.col("n")).alias("at"), "ord")
    return selections.gather(rows, index).select("sample_id", "ord")


@query("SELECT c_custkey, 'GSM' || c_custkey AS accession FROM customer WHERE c_custkey % 3 = 0")
def accession_filter(spark, d):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("GSM"), F.col("c_custkey"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("GSM"), F.col("c_custkey"), F.lit("x"))).otherwise(F.lit("control"))
    return selections.with_accession(table(spark, d, "customer").select("c_custkey", name.alias("accession")), "accession")


_CELLS = "SELECT unnest(['custkey', 'segment', 'balance', 'mixed']) AS col, unnest([c_custkey::VARCHAR, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR END, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR ELSE 'none' END]) AS value FROM customer"


@query(f"SELECT *, numeric AND n_distinct > 10 AS histogram FROM (SELECT col, count(value) AS n, count(TRY_CAST(value AS DOUBLE)) AS n_numeric, count(DISTINCT TRY_CAST(value AS DOUBLE)) AS n_distinct, count(TRY_CAST(value AS DOUBLE)) >= greatest(3, floor(0.7 * count(value))) AS numeric FROM ({_CELLS}) GROUP BY col)")
def numeric_majority(spark, d):
    nation = F.col("c_nationkey").cast("string")
    cells = {"custkey": F.col("c_custkey").cast("string"), "segment": F.col("c_mktsegment"), "balance": F.when(F.col("c_custkey") % 2 == 0, nation), "mixed": F.when(F.col("c_custkey") % 2 == 0, nation).otherwise("none")}
    long = table(spark, d, "customer").select(F.explode(F.array(*(F.struct(F.lit(k).alias("col"), v.alias("value")) for k, v in cells.items()))).alias("c")).select("c.*")
    return selections.numeric_majority(long, ["col"])


@query("SELECT 'GSM' || vec_id AS sample, 'GSE' || label AS study, vec_id::BIGINT AS matrix_row, '[GSE' || label || '](https://example.org/?acc=GSE' || label || ')' AS link FROM embeddings")
def canonical_samples(spark, d):
    rows = table(spark, d, "embeddings").select(F.concat(F.lit(" GSM"), F.col("vec_id")).alias("accession"), F.concat(F.lit("GSE"), F.col("label")).alias("gse"), F.col("vec_id").alias("row"))
    return selections.canonical_samples(rows, "accession", "gse", "row", "https://example.org/?acc=")


@query("SELECT s_suppkey AS run, s_nationkey AS arm, s_acctbal AS score, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey")
def one_to_one_join(spark, d):
    return selections.joined_one_to_one(_runs(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("run"), "n_name"), ["run"])


@query(sql(f" SELECT a.repeat, a.fold, {r('a.rmse')} AS rmse_frozen, {r('b.rmse')} AS rmse_nested FROM met a JOIN met b ON a.repeat = b.repeat AND a.fold = b.fold AND a.model_id = 'AF' AND b.model_id = 'RF'", "met"))
def paired_metrics(spark, d):
    m = I.metrics(spark, d)
    one = lambda name: m.filter(F.col("model_id") == name)
    return rounded(selections.paired(one("AF"), one("RF"), ["repeat", "fold"], ["rmse"], ("frozen", "nested"), one("AF").count()))


@query("SELECT s_suppkey AS run, s_nationkey AS arm, s_acctbal AS score, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey WHEN s_suppkey % 3 = 1 THEN s_nationkey + 1 END AS earlier_arm, CASE WHEN s_suppkey % 3 = 0 THEN 'yes' ELSE 'no-or-unknown' END AS checkpoint_match FROM supplier")
def earlier_and_final(spark, d):
    runs = _runs(spark, d)
    earlier = runs.filter("run % 3 <> 2").select("run", (F.col("arm") + (F.col("run") % 3)).alias("arm"))
    return selections.earlier_and_final(runs, earlier, "run", "arm")


@query(sql(f" SELECT split, {r('sum((value - value / 2) * (value - value / 2))', 4)} AS sse, count(*) AS n, {r('sum((value - value / 2) * (value - value / 2)) / count(*)')} AS mse, {r('sum(value)', 4)} AS sum_y, {r('sum(value * value)', 4)} AS sum_y2, {r('1 - sum((value - value / 2) * (value - value / 2)) / (sum(value * value) - sum(value) * sum(value) / count(*))')} AS r2 FROM cells GROUP BY split", "cells"))
def reconstruction_totals(spark, d):
    rows = I.matrix(spark, d).withColumn("half", F.transform("values", lambda x: x / 2))
    out = selections.reconstruction_totals(rows, ["split"], "values", "half")
    return out.select("split", "n", *((F.round(c, k) + F.lit(0.0)).alias(c) for c, k in (("sse", 4), ("mse", 6), ("sum_y", 4), ("sum_y2", 4), ("r2", 6))))


@query(sql(" SELECT count(*) AS memberships, count(DISTINCT sample) AS samples, (SELECT count(*) FROM (SELECT sample FROM occ GROUP BY sample HAVING count(DISTINCT study) > 1)) AS multi_study, count(*) - count(DISTINCT sample) AS extra_memberships, count(DISTINCT study) AS studies, (SELECT count(*) FROM supplier) AS archives, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS sound_archives, (SELECT max(abs(s_acctbal)) FROM supplier) AS max_abs, (SELECT max(abs(s_acctbal) / 2) FROM supplier) AS rmse FROM occ", "occ"))
def store_status(spark, d):
    own = table(spark, d, "supplier")
    archives = own.select(F.when(F.col("s_acctbal") > 0, "Yes").otherwise("0").alias("ok"))
    return selections.store_status(I.occurrences(spark, d), "sample", "study", archives, own.select(F.abs("s_acctbal").alias("max_abs"), (F.abs("s_acctbal") / 2).alias("rmse")))


@query("SELECT coalesce(e.s_nationkey, o.s_nationkey) AS s_nationkey, e.s_nationkey IS NOT NULL AS expected, o.s_nationkey IS NOT NULL AS observed FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 3000) e FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 2000) o ON e.s_nationkey = o.s_nationkey")
def expected_and_observed(spark, d):
    s = table(spark, d, "supplier")
    return selections.expected_and_observed(s.filter("s_acctbal > 3000"), s.filter("s_acctbal < 2000"), ["s_nationkey"])


_KINDS = "SELECT 'raw' AS kind, log2(greatest(value, 1e-6)) AS value FROM raw UNION ALL SELECT 'normalized', value - 0.25 FROM cells"


@query(sql(f", v AS ({_KINDS}), e AS (SELECT min(value) AS lo, max(value) AS hi FROM v), b AS (SELECT kind, least(69, floor((value - lo) / ((hi - lo) / 70)))::INT AS bin, (hi - lo) / 70 AS w FROM v, e) SELECT kind, bin, count(*) AS n, {r('count(*) / (sum(count(*)) OVER (PARTITION BY kind) * any_value(w))')} AS density FROM b GROUP BY kind, bin", "raw", "cells"))
def raw_and_normalized_densities(spark, d):
    raw = I.raw_matrix(spark, d).select(F.lit("raw").alias("kind"), F.explode(F.transform("values", lambda x: training.log2_clipped(x))).alias("value"))
    normal = I.matrix(spark, d).select(F.lit("normalized").alias("kind"), F.explode(F.transform("values", lambda x: x - 0.25)).alias("value"))
    return rounded(selections.densities(raw.unionByName(normal), "kind"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) - 1 AS position FROM supplier")
def stable_sort(spark, d):
    return order.numbered(table(spark, d, "supplier"), [F.col("s_nationkey"), F.col("s_acctbal").desc(), F.col("s_suppkey")]).select("s_suppkey", "position")


@query(sql(", p AS (SELECT *, row_number() OVER (ORDER BY patient) - 1 AS k, count(*) OVER () AS n FROM pat), places AS (SELECT DISTINCT CASE WHEN i = 34 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 34.0))::BIGINT END AS k FROM (SELECT DISTINCT n FROM p), (SELECT unnest(range(0, 35)) AS i)) SELECT p.patient, p.k AS position FROM p JOIN places USING (k)", "pat"))
def spread_patients(spark, d):
    return selections.spread(I.patients(spark, d), ["patient"], ["patient"], 35).select("patient", "position")


@query(sql(", p AS (SELECT *, dense_rank() OVER (ORDER BY sample_id) - 1 AS k, (SELECT count(DISTINCT sample_id) FROM cells) AS n FROM cells), places AS (SELECT DISTINCT CASE WHEN i = 23 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 23.0))::BIGINT END AS k FROM (SELECT DISTINCT n FROM p), (SELECT unnest(range(0, 24)) AS i)) SELECT row_number() OVER (ORDER BY sample_id, pos) - 1 AS position, round(value, 6) + 0.0 AS value FROM p JOIN places USING (k)", "cells"))
def pooled_sample(spark, d):
    return rounded(selections.pooled_values(I.matrix(spark, d), "ord"))


@query("SELECT sample, row_number() OVER (ORDER BY first_at, sample) - 1 AS position FROM (SELECT l_partkey AS sample, min(l_orderkey) AS first_at FROM lineitem WHERE l_suppkey % 7 = 0 GROUP BY l_partkey)")
def ordered_samples(spark, d):
    rows = table(spark, d, "lineitem").filter("l_suppkey % 7 = 0").groupBy(F.col("l_partkey").alias("sample")).agg(F.min("l_orderkey").alias("at"))
    return order.numbered(rows, [F.col("at"), F.col("sample")]).select("sample", "position")


@query("SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def ids_of_all_methods(spark, d):
    return selections.in_all(table(spark, d, "lineitem"), "l_linenumber", "l_suppkey")


@query(sql(f" SELECT model_id, repeat, fold, {r('rmse')} AS rmse, CASE WHEN model_id = 'NO' THEN 'frozen' ELSE 'nested' END AS protocol, CASE WHEN model_id = 'NO' THEN 1 END AS seed, concat_ws(':', CASE WHEN model_id = 'NO' THEN 'frozen' ELSE 'nested' END, model_id, repeat, fold) AS comparison_id FROM met", "met"))
def comparison_table(spark, d):
    m = I.metrics(spark, d)
    return rounded(selections.comparison({"nested": m.filter("model_id <> 'NO'"), "frozen": m.filter("model_id = 'NO'").withColumn("seed", F.lit(1))}, ["model_id", "repeat", "fold"]))


@query("SELECT 'canonical_GSE' AS label, count(*) AS n, count(DISTINCT s_nationkey) AS studies FROM supplier")
def dataset_label(spark, d):
    rows = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") > 1, F.col("s_nationkey")).alias("GSE"), F.col("s_nationkey").alias("canonical_GSE"))
    label = selections.dataset_labels(rows)
    return rows.agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("studies"))


@query(f"SELECT s_suppkey::BIGINT AS epoch, {r('0.5 * least(1.0, s_suppkey / 20)')} AS kl, {r('0.001 * (0.1 + 0.9 * (1 + cos(pi() * least(s_suppkey, 50) / 50)) / 2)', 9)} AS rate FROM supplier")
def schedules(spark, d):
    epoch = F.col("s_suppkey")
    return table(spark, d, "supplier").select(epoch.cast("bigint").alias("epoch"), (F.round(training.kl_weight(epoch, 0.5, 20), 6) + F.lit(0.0)).alias("kl"), (F.round(training.cosine_rate(epoch, 0.001, 50, 0.1), 9) + F.lit(0.0)).alias("rate"))


@query(sql(f" SELECT sample_id, {r('sum((value * value + exp(value / 4) - value / 4 - 1) / 2)')} AS kl FROM cells GROUP BY sample_id", "cells"))
def kl_divergence(spark, d):
    rows = I.matrix(spark, d)
    return rounded(rows.select("sample_id", training.kl_to_standard_normal("values", F.transform("values", lambda x: x / 4)).alias("kl")))


@query("SELECT p_partkey, p_size, (2 * (100::BIGINT * p_size + p_size::BIGINT * 8 + 8 * 3) + 100 + 2 * p_size + 2 * 8 + 3)::BIGINT AS parameters, 'pca_global_rma_d' || p_size AS model FROM part")
def parameter_counts(spark, d):
    size = F.col("p_size").cast("int")
    return table(spark, d, "part").select("p_partkey", "p_size", training.autoencoder_parameters(F.lit(100), F.array(size, F.lit(8)), F.lit(3)).alias("parameters"), training.pca_name(F.lit("Global RMA"), size, 2, 2).alias("model"))


_ENC = "SELECT 'run_' || s_suppkey AS path, 'm' || s_nationkey % 3 AS method, 'a' || s_suppkey % 2 AS architecture, s_acctbal AS score FROM supplier"


@query(f"WITH e AS ({_ENC}), t AS (SELECT * FROM e ORDER BY score, path LIMIT 1), u AS (SELECT *, 'overall' AS label, 0 AS place FROM t UNION ALL SELECT * FROM (SELECT *, 'best_other_architecture', 1 FROM e WHERE architecture <> (SELECT architecture FROM t) ORDER BY score, path LIMIT 1) UNION ALL SELECT path, method, architecture, score, 'best_' || method, 2 FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score, path) AS k FROM e) WHERE k = 1) SELECT path, label, score, method, architecture FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY place, label) AS k FROM u) WHERE k = 1")
def best_encoders(spark, d):
    s = table(spark, d, "supplier")
    return selections.best_encoders(s.select(F.concat(F.lit("run_"), "s_suppkey").alias("path"), F.concat(F.lit("m"), F.col("s_nationkey") % 3).alias("method"), F.concat(F.lit("a"), F.col("s_suppkey") % 2).alias("architecture"), F.col("s_acctbal").alias("score")))


@query("WITH p AS (SELECT o_custkey::VARCHAR AS fit_id, o_orderkey AS path_index, o_totalprice AS aic, -o_totalprice AS bic FROM orders) SELECT fit_id, 'aic' AS criterion, arg_min(path_index, (aic, path_index)) AS path_index, min(aic) AS value FROM p GROUP BY fit_id UNION ALL SELECT fit_id, 'bic', arg_min(path_index, (bic, path_index)), min(bic) FROM p GROUP BY fit_id")
def criteria_winners(spark, d):
    path = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("fit_id"), F.col("o_orderkey").alias("path_index"), F.col("o_totalprice").alias("aic"), (-F.col("o_totalprice")).alias("bic"))
    return selections.criteria_winners(path)


@query(sql(f", c AS (SELECT repeat, fold, arg_min(model_id, (rmse, model_id)) AS won FROM met WHERE model_id <> 'AF' GROUP BY repeat, fold) SELECT m.repeat, m.fold, 'winner_z' AS model_id, m.model_id AS source_model, {r('rmse')} AS rmse FROM met m JOIN c ON m.repeat = c.repeat AND m.fold = c.fold AND model_id = won UNION ALL SELECT repeat, fold, model_id, model_id, {r('rmse')} FROM met WHERE model_id = 'AF'", "met"))
def nested_assembly(spark, d):
    m = I.metrics(spark, d)
    choice = m.filter("model_id <> 'AF'").groupBy("repeat", "fold").agg(F.min_by("model_id", F.struct("rmse", "model_id")).alias("model_id"))
    return rounded(selections.assembled(m, choice, ["AF"]).select("repeat", "fold", "model_id", "source_model", "rmse"))


# --- contracts, on tables with planted faults


@query("SELECT c_custkey, 'D' || c_custkey || '_L' AS sample_id, CASE WHEN c_custkey % 11 = 0 THEN 'D0' ELSE 'D' || c_custkey END AS donor, CASE WHEN c_custkey % 13 = 0 THEN 'related' ELSE 'eligible' END AS role, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 13 = 0 AND c_custkey % 11 = 0 THEN 'train' ELSE 'validation' END AS split, unnest(list_filter([CASE WHEN c_custkey % 11 = 0 AND c_custkey <> 0 THEN 'donor' WHEN c_custkey % 13 = 0 THEN 'role' END, CASE WHEN c_custkey % 11 = 0 THEN 'split' END], lambda x: x IS NOT NULL)) AS problem FROM customer")
def role_faults(spark, d):
    k = F.col("c_custkey")
    donor = F.when(k % 11 == 0, "D0").otherwise(F.concat(F.lit("D"), k))
    split = F.when((k % 2 == 0) | ((k % 13 == 0) & (k % 11 == 0)), "train").otherwise("validation")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("D"), k, F.lit("_L")).alias("sample_id"), donor.alias("donor"), F.when(k % 13 == 0, "related").otherwise("eligible").alias("role"), split.alias("split"))
    return contracts.role_faults(rows)


@query("SELECT c_custkey::VARCHAR AS id, 'missing' AS problem FROM customer WHERE c_custkey % 50 = 1 UNION ALL SELECT (-c_custkey)::VARCHAR, 'unknown id' FROM customer WHERE c_custkey % 50 = 1 UNION ALL SELECT c_custkey::VARCHAR, 'repeated' FROM customer WHERE c_custkey % 50 = 2 UNION ALL SELECT c_custkey::VARCHAR, 'label' FROM customer WHERE c_custkey % 50 = 3 UNION ALL SELECT c_nationkey::VARCHAR, 'crosses parts' FROM (SELECT c_nationkey, CASE WHEN c_custkey % 50 = 3 THEN 'other' WHEN c_nationkey = 7 AND c_custkey % 2 = 0 THEN 'test' ELSE 'train' END AS s FROM customer) GROUP BY c_nationkey HAVING count(DISTINCT s) > 1")
def saved_split_faults(spark, d):
    k = F.col("c_custkey")
    wanted = table(spark, d, "customer").select(k.alias("sample"))
    split = F.when(k % 50 == 3, "other").when((F.col("c_nationkey") == 7) & (k % 2 == 0), "test").otherwise("train")
    saved = table(spark, d, "customer").select(F.when(k % 50 == 1, -k).otherwise(k).alias("sample"), F.col("c_nationkey").alias("component"), split.alias("split"))
    return contracts.saved_split_faults(saved.unionByName(saved.filter("sample % 50 = 2")), wanted)


@query("SELECT s_suppkey AS at, CASE WHEN s_suppkey % 9 <> 4 THEN s_nationkey END AS first, CASE WHEN s_suppkey % 9 = 4 THEN s_nationkey WHEN s_suppkey % 9 = 5 THEN s_nationkey + 1 END AS second FROM supplier WHERE s_suppkey % 9 IN (4, 5, 6)")
def not_same_order(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_nationkey").alias("id"))
    other = s.filter("ord % 9 <> 6").withColumn("id", F.when(F.col("ord") % 9 == 5, F.col("id") + 1).otherwise(F.col("id")))
    return contracts.not_same_order(s.filter("ord % 9 <> 4"), other, "id")


@query("SELECT s_suppkey, 'balance' AS setting, s_acctbal AS value, 0.0::DOUBLE AS low, 5000.0::DOUBLE AS high FROM supplier WHERE s_acctbal NOT BETWEEN 0 AND 5000 UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE, 3.0, 24.0 FROM supplier WHERE s_nationkey < 3")
def settings_out_of_range(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return contracts.out_of_range(s, {"balance": (0, 5000), "nation": (3, 24)})


@query("SELECT 0::INT AS pos, 0::BIGINT AS n_not_finite, 1::BIGINT AS n_values, false AS varies UNION ALL SELECT 1, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0), (SELECT count(DISTINCT CASE WHEN vec_id % 5 <> 0 THEN vec_id END) + CASE WHEN count(*) FILTER (vec_id % 5 = 0 AND label % 10 < 8) > 0 THEN 1 ELSE 0 END FROM embeddings WHERE label % 10 < 8), (SELECT count(DISTINCT vec_id) > 1 FROM embeddings WHERE label % 10 < 8 AND vec_id % 5 <> 0)")
def unfit_features(spark, d):
    rows = I.matrix(spark, d)
    odd = F.when(F.col("sample_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("sample_id").cast("double"))
    rows = rows.select("sample_id", (F.col("split") == "train").alias("train"), F.array(F.lit(1.0), odd, F.col("sample_id") * 2.0).alias("values"))
    return contracts.unfit_matrix(rows, "train")


@query("SELECT s_suppkey AS path FROM supplier WHERE s_suppkey % 4 <> 0")
def checkpoints_not_identical(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("size"), F.col("s_suppkey").alias("mtime"), (F.col("s_acctbal") + 20000).alias("score"))
    k = F.col("path") % 4
    b = a.filter(k != 1).withColumn("size", F.when(k == 2, F.col("size") + 1).otherwise(F.col("size"))).withColumn("score", F.when(k == 3, F.col("score") * 1.001).otherwise(F.col("score") * (1 + 1e-12)))
    return contracts.not_identical(a, b, ["path"])


@query(sql(" SELECT sample_id, 'first' AS side FROM (SELECT DISTINCT sample_id, study, split FROM cells) WHERE split = 'train' AND study % 10 = 0 UNION ALL SELECT DISTINCT sample_id, 'second' FROM cells WHERE split = 'test'", "cells"))
def reference_fit_ids(spark, d):
    rows = I.matrix(spark, d).select("sample_id", "study", "split")
    return contracts.not_fitted_on(rows, rows.filter("(split = 'train' AND study % 10 <> 0) OR split = 'test'"), "sample_id")


_SIZE = "CASE WHEN x < 1024 THEN x || ' B' WHEN x < 1048576 THEN printf('%.1f KiB', x / 1024.0) WHEN x < 1073741824 THEN printf('%.1f MiB', x / 1048576.0) WHEN x < 1099511627776 THEN printf('%.1f GiB', x / 1073741824.0) ELSE printf('%.1f TiB', x / 1099511627776.0) END"


@query(f"SELECT c_custkey, 'GSM' || c_custkey AS gsm, 'GSE' || c_nationkey AS gse, {_SIZE} AS size, '[GSE' || c_nationkey || '](u?acc=GSE' || c_nationkey || ')' AS link, 'a_b_' || c_custkey AS safe, 'P' || c_custkey AS donor FROM (SELECT *, c_custkey * (10 ** (3 * (c_custkey % 5)))::BIGINT + CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 7 END AS x FROM customer)")
def identifier_functions(spark, d):
    k, n = F.col("c_custkey").cast("string"), F.concat(F.lit("gse"), F.col("c_nationkey"))
    size = F.col("c_custkey") * F.pow(F.lit(10.0), 3 * (F.col("c_custkey") % 5)).cast("bigint") + F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(7)
    return table(spark, d, "customer").select(
        "c_custkey", ids.gsm_of_path(F.concat(F.lit("/x/gsm"), k, F.lit("_a.CEL.gz"))).alias("gsm"), ids.study_of_archive(F.concat(F.lit("/y/"), n, F.lit("_RAW.tar"))).alias("gse"), ids.byte_size(size).alias("size"),
        ids.markdown_link(F.upper(n), ids.accession_url(n, "u?acc=")).alias("link"), ids.safe_name(F.concat(F.lit("a b/"), k)).alias("safe"), ids.donor_of_patient(F.concat(F.lit("P"), k, F.lit("_3m"))).alias("donor"),
    )


_SETTINGS_SQL = "SELECT o_orderkey, 'dropout' AS setting, (o_orderkey % 11 / 10.0)::DOUBLE AS v, 0.0 AS low, 1.0 AS high, false AS lo, true AS ho FROM orders UNION ALL SELECT o_orderkey, 'learning_rate', (o_orderkey % 4 / 4.0)::DOUBLE, 0.0, 1e300, true, false FROM orders UNION ALL SELECT o_orderkey, 'residual_blocks', (o_orderkey % 12)::DOUBLE, 0.0, 8.0, false, false FROM orders UNION ALL SELECT o_orderkey, 'mask_fraction', (o_orderkey % 3 / 2.0)::DOUBLE, 0.0, 1.0, true, true FROM orders"


@query(f"SELECT o_orderkey, setting FROM ({_SETTINGS_SQL}) WHERE v < low OR v > high OR (lo AND v = low) OR (ho AND v = high) UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderpriority IN ('5-LOW', '3-MEDIUM')")
def setting_faults(spark, d):
    """Settings of runs on, inside and outside the ends of their ranges."""
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select("o_orderkey", (k % 11 / 10).alias("dropout"), (k % 4 / 4).alias("learning_rate"), (k % 12).alias("residual_blocks"), (k % 3 / 2).alias("mask_fraction"), F.col("o_orderpriority").alias("priority"))
    return contracts.setting_faults(runs, "o_orderkey", {"priority": {"1-URGENT", "2-HIGH", "4-NOT SPECIFIED"}}).select("o_orderkey", "setting")


_LINES = "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_orderkey % 97 = 0 THEN 'held' WHEN l_returnflag = 'A' THEN 'train' WHEN l_returnflag = 'N' THEN 'validation' ELSE 'test' END AS split, CASE WHEN l_partkey % 50 = 0 THEN 'x:' || l_orderkey ELSE 'geo:' || l_orderkey END AS key FROM lineitem"


@query(f"WITH l AS ({_LINES}) SELECT 'label' AS contract, split AS item, 1::BIGINT AS n FROM l WHERE split = 'held' GROUP BY split UNION ALL SELECT 'namespace', key, count(*) FROM l WHERE key LIKE 'x:%' GROUP BY key UNION ALL SELECT 'crossing', l_suppkey::VARCHAR, count(DISTINCT split) FROM l GROUP BY l_suppkey HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'incomplete', l_orderkey::VARCHAR, count(*) FROM l GROUP BY l_orderkey HAVING count(*) <> 4")
def contract_faults(spark, d):
    """Unknown labels, foreign namespaces, groups in several parts and incomplete sets, each as a contract finds them."""
    part = F.when(F.col("l_orderkey") % 97 == 0, "held").when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "validation").otherwise("test")
    key = F.concat(F.when(F.col("l_partkey") % 50 == 0, "x:").otherwise("geo:"), F.col("l_orderkey").cast("string"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", part.alias("split"), key.alias("key"))
    named = lambda df, contract, item, n: df.select(F.lit(contract).alias("contract"), F.col(item).cast("string").alias("item"), n.cast("bigint").alias("n"))
    out = named(contracts.wrong_labels(rows, "split", {"train", "validation", "test"}, True), "label", "label", F.lit(1))
    foreign = contracts.unknown_namespace(rows, "key", {"geo"}).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(named(foreign, "namespace", "key", F.col("n")))
    out = out.unionByName(named(contracts.crossing(rows, "l_suppkey", "split"), "crossing", "l_suppkey", F.col("parts")))
    return out.unionByName(named(contracts.incomplete(rows, ["l_orderkey"], 4), "incomplete", "l_orderkey", F.col("n")))

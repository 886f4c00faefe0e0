"""Queries of evaluation designs, components and penalized models, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from assaylake.operators import background, checkpoints, designs, models, normalize, sums
from assaylake.plans import inputs as I
from assaylake.plans.catalogue import query, r, rounded
from assaylake.plans.inputs import sql, table

SINGLES = {"balance": "Balance", "nation": "Nation", "owed": "Owed"}


def people(spark, d):
    """Customers that have a vector, as patients."""
    own = table(spark, d, "customer").join(table(spark, d, "embeddings"), F.col("c_custkey") == F.col("vec_id"))
    return own.select(F.col("c_custkey").alias("patient"), F.floor(F.col("c_custkey") / 2).alias("donor"), "c_acctbal", "c_nationkey", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def features(rows):
    """Two encoders, the halves of a vector; clinical variables, one of them missing where a customer owes nothing."""
    owed = F.when(F.col("c_acctbal") < 0, -F.col("c_acctbal"))
    clinical = {"balance": [F.col("c_acctbal")], "nation": [F.col("c_nationkey").cast("double")], "owed": [owed]}
    clinical["clinical_full"] = [v for x in clinical.values() for v in x]
    blocks = {"z_first": F.slice("x", 1, 32), "z_last": F.slice("x", 33, 32)} | {name: F.array(*x) for name, x in clinical.items()}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("block"), x.alias("x")) for name, x in blocks.items())))
    return rows.select("patient", each.alias("b")).select("b.block", "patient", "b.x")


ENCODERS = {"z_first": "First half", "z_last": "Last half"}
CATALOGUES = {
    "fixed": designs.fixed_catalogue(ENCODERS, singles=SINGLES, key="balance"),
    "nested": designs.nested_catalogue(ENCODERS, singles=SINGLES, key="balance"),
}


def outcomes(spark, d):
    return I.outcomes_long(spark, d).withColumn("egfr", F.col("egfr") / 1000)


def _folds(rows, kind):
    return designs.fixed_folds(rows, 3, 2, 5) if kind == "fixed" else designs.nested_folds(rows, 3, 1, 2, 5)


def _design(spark, d, kind):
    rows = people(spark, d)
    folds = _folds(rows, kind)
    return designs.design(folds, designs.scaled(folds, features(rows)), CATALOGUES[kind], outcomes(spark, d))


def _summary(rows):
    """Sums over the rows of a fit that no reordering of features leaves alone."""
    weighted = lambda c: F.sum(F.aggregate(F.transform(c, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x))
    found = rows.groupBy("fit_id", *designs.FOLD, "model_id", "candidate_id", "is_train").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("patient").alias("n_patients"), F.max(F.size("main")).alias("n_main"), F.max(F.size("x")).alias("n_timed"), F.sum("egfr").alias("egfr"),
        weighted("main").alias("main"), weighted("x").alias("timed"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x) * (F.col("time_ord") + 1)).alias("timed_squares"),
    )
    return rounded(found, 4)


def _part(rank: str, n: str, parts: int) -> str:
    size, more = f"({n} // {parts})", f"({n} % {parts})"
    return f"CASE WHEN {rank} < {more} * ({size} + 1) THEN {rank} // ({size} + 1) ELSE {more} + ({rank} - {more} * ({size} + 1)) // greatest({size}, 1) END"


def _hash(seed: str) -> str:
    return f"('0x' || substr(md5(({seed})::VARCHAR || ':' || donor::VARCHAR), 1, 13))::BIGINT"


def _design_sql(kind: str) -> str:
    splits, repeats, stage = (3, 2, designs.FIXED) if kind == "fixed" else (3, 1, designs.OUTER)
    folds = f"""
 p AS (SELECT c_custkey AS patient, c_custkey // 2 AS donor, c_acctbal, c_nationkey, embedding FROM customer JOIN embeddings ON c_custkey = vec_id),
 h AS (SELECT repeat, donor, row_number() OVER (PARTITION BY repeat ORDER BY {_hash('5 + repeat')}, donor) - 1 AS rank, count(*) OVER (PARTITION BY repeat) AS n FROM (SELECT DISTINCT donor FROM p), (SELECT unnest(range(0, {repeats})) AS repeat)),
 f AS (SELECT '{stage}' AS stage, repeat, fold, -1 AS inner_fold, patient, donor, {_part('rank', 'n', splits)} <> fold AS is_train FROM h JOIN p USING (donor), (SELECT unnest(range(0, {splits})) AS fold))"""
    if kind == "nested":
        folds += f""",
 g AS (SELECT repeat, fold, donor, row_number() OVER (PARTITION BY repeat, fold ORDER BY {_hash('10005 + repeat * 101 + fold')}, donor) - 1 AS rank, count(*) OVER (PARTITION BY repeat, fold) AS n FROM (SELECT DISTINCT repeat, fold, donor FROM f WHERE is_train)),
 a AS (SELECT * FROM f UNION ALL SELECT '{designs.INNER}', repeat, fold, i, patient, donor, {_part('rank', 'n', 2)} <> i FROM g JOIN p USING (donor), (SELECT unnest(range(0, 2)) AS i))"""
    else:
        folds += ", a AS (SELECT * FROM f)"
    literal = lambda x: "NULL" if x is None else f"'{x}'"
    catalogue = ", ".join(f"('{m.stage}', '{m.model_id}', '{m.candidate_id}', {literal(m.main)}, {literal(m.timed)})" for m in CATALOGUES[kind])
    fit = "'fixed_r' || lpad(repeat::VARCHAR, 3, '0') || '_f' || lpad(fold::VARCHAR, 3, '0') || '_' || model_id" if kind == "fixed" else f"CASE WHEN stage = '{designs.INNER}' THEN 'inner_r' || repeat || '_f' || fold || '_i' || inner_fold || '_' || model_id ELSE 'outer_r' || repeat || '_f' || fold || '_' || model_id END"
    key = "stage, repeat, fold, inner_fold"
    return sql(
        f""", {folds},
 owed AS (SELECT patient, CASE WHEN c_acctbal < 0 THEN -c_acctbal END AS v FROM p),
 c AS (SELECT patient, 'z_first' AS block, unnest(range(0, 32)) AS pos, unnest(embedding[1:32])::DOUBLE AS v FROM p UNION ALL SELECT patient, 'z_last', unnest(range(0, 32)), unnest(embedding[33:64])::DOUBLE FROM p
  UNION ALL SELECT patient, b, pos, c_acctbal FROM p, (VALUES ('balance', 0), ('clinical_full', 0)) AS t(b, pos) UNION ALL SELECT patient, b, pos, c_nationkey::DOUBLE FROM p, (VALUES ('nation', 0), ('clinical_full', 1)) AS t(b, pos)
  UNION ALL SELECT patient, b, pos, v FROM owed, (VALUES ('owed', 0), ('clinical_full', 2)) AS t(b, pos)),
 x AS (SELECT a.* EXCLUDE (donor), block, pos, v FROM a JOIN c USING (patient)),
 m AS (SELECT {key}, block, pos, quantile_cont(v, 0.5) AS med FROM x WHERE is_train GROUP BY ALL),
 y AS (SELECT x.* REPLACE (coalesce(v, med) AS v) FROM x JOIN m USING ({key}, block, pos)),
 s AS (SELECT {key}, block, pos, avg(v) AS mean, stddev_pop(v) AS sd FROM y WHERE is_train GROUP BY ALL),
 w AS (SELECT {key}, block, patient, count(*) AS size, sum((pos + 1) * ((v - mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END)) AS one, sum(pow((v - mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 2)) AS two FROM y JOIN s USING ({key}, block, pos) GROUP BY ALL),
 k(stage, model_id, candidate_id, main, timed) AS (VALUES {catalogue}),
 e AS (SELECT a.*, k.* EXCLUDE (stage), {fit} AS fit_id, time_ord, egfr / 1000 AS egfr FROM a JOIN k USING (stage) JOIN long USING (patient))
SELECT fit_id, e.stage, e.repeat::INT AS repeat, e.fold::INT AS fold, e.inner_fold::INT AS inner_fold, model_id, candidate_id, is_train, count(*) AS n, count(DISTINCT e.patient) AS n_patients, max(coalesce(wm.size, 0))::INT AS n_main, max(coalesce(wt.size, 0))::INT AS n_timed,
 {r('sum(egfr)', 4)} AS egfr, {r('sum(coalesce(wm.one, 0.0))', 4)} AS main, {r('sum(coalesce(wt.one, 0.0))', 4)} AS timed, {r('sum(coalesce(wt.two, 0.0) * (time_ord + 1))', 4)} AS timed_squares
FROM e LEFT JOIN w wm ON wm.block = e.main AND wm.patient = e.patient AND wm.stage = e.stage AND wm.repeat = e.repeat AND wm.fold = e.fold AND wm.inner_fold = e.inner_fold
 LEFT JOIN w wt ON wt.block = e.timed AND wt.patient = e.patient AND wt.stage = e.stage AND wt.repeat = e.repeat AND wt.fold = e.fold AND wt.inner_fold = e.inner_fold
GROUP BY ALL""",
        "long",
    )


@query(_design_sql("fixed"))
def fixed_design(spark, d):
    return _summary(_design(spark, d, "fixed"))


@query(_design_sql("nested"))
def nested_design(spark, d):
    return _summary(_design(spark, d, "nested"))


@query()
def fixed_evaluation(spark, d):
    """Time, encoders and fold-fitted components with and without clinical variables, each fitted in each fold."""
    rows = people(spark, d)
    folds = designs.fixed_folds(rows, 3, 2, 5)
    components = designs.component_blocks(folds, rows.select("patient", "x"), (2, 8))
    catalogue = designs.fixed_catalogue(ENCODERS, {"pca_d2": "PCA 2", "pca_d8": "PCA 8"}, SINGLES, "balance")
    return designs.evaluated(designs.design(folds, designs.scaled(folds, features(rows), components), catalogue, outcomes(spark, d)))


@query()
def nested_evaluation(spark, d):
    """The candidate that each outer fold's inner folds select, and how it does in the outer one."""
    return designs.selected(sums.kept(designs.evaluated(_design(spark, d, "nested")), "nested-evaluation"))


def cosines(n: int, k: int) -> np.ndarray:
    """Orthonormal columns: the first cosines of a transform of n points."""
    at = np.pi * (np.arange(n)[:, None] + 0.5) * np.arange(1, k + 1) / n
    return np.sqrt(2 / n) * np.cos(at)


_PROJECTED = f", m AS (SELECT pos, avg(value) AS mean FROM cells WHERE split = 'train' GROUP BY pos) SELECT sample_id, k::INT AS component, {r('sum((value - mean) * sqrt(2.0 / 64) * cos(pi() * (pos + 0.5) * (k + 1) / 64))')} AS score FROM cells JOIN m USING (pos), (SELECT unnest(range(0, 8)) AS k) GROUP BY sample_id, k"


@query(sql(_PROJECTED, "cells"))
def pca_projection(spark, d):
    """Scores on given loadings, off the training mean."""
    rows = I.matrix(spark, d)
    mean = np.array(sums.moments(rows.filter("split = 'train'"), []).first()["mean"])
    found = models.project(rows.select("sample_id", "values"), [], {(): models.Components(mean, cosines(64, 8), np.zeros(8))}, "values")
    return rounded(found.select("sample_id", F.posexplode("scores").alias("component", "score")))


def _lasso(spark, d):
    """Halves of the patients that have a vector, by donor: what is trained on and what is predicted."""
    rows = people(spark, d)
    folds = designs.fixed_folds(rows, 2, 1, 9)
    scaled = designs.scaled(folds, features(rows).filter("block IN ('z_first', 'z_last')"))
    x = scaled.groupBy(*designs.FOLD, "patient").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "x"))), lambda b: b["x"])).alias("x"))
    rows = folds.join(x, [*designs.FOLD, "patient"]).join(outcomes(spark, d), "patient")
    return rows.select(F.concat(F.lit("f"), F.col("fold").cast("string")).alias("fit_id"), "is_train", "patient", "donor", "time_ord", "egfr", "x")


@query()
def lasso_selection(spark, d):
    """What AIC and BIC choose from one path for each fold, and its errors on the patients that were left out."""
    rows = _lasso(spark, d)
    paths = sums.kept(models.lasso_paths(rows.filter("is_train").drop("is_train", "donor")), "lasso-paths")
    chosen = models.lasso_chosen(paths)
    return models.lasso_metrics(models.lasso_predictions(rows.filter("NOT is_train").drop("is_train"), chosen), chosen)


@query()
def background_corrected(spark, d):
    """Vectors as arrays of intensities without their background."""
    rows = I.matrix(spark, d).select("sample_id", F.transform("values", lambda x: 100 + 10 * F.exp(x * 8)).alias("values"))
    return rounded(background.corrected(rows, "sample_id").select("sample_id", F.posexplode("values").alias("pos", "value"), "mu", "sigma"), 4)


@query()
def frozen_polish(spark, d):
    """Summaries of all samples by the effects that training samples froze, and how far they are from the polish's own there."""
    cells = normalize.long_form(I.raw_matrix(spark, d), "sample_id", "split").select(F.floor(F.col("pos") / 8).alias("probe_set"), F.col("pos").cast("bigint").alias("cell"), F.col("sample_id").alias("sample"), F.log2("value").alias("value"), "split")
    effects, off = models.frozen_effects(cells.filter("split = 'train'").drop("split"))
    found = cells.join(effects, ["probe_set", "cell"]).groupBy("probe_set", "sample").agg(F.percentile(F.col("value") - F.col("effect"), F.lit(0.5)).alias("summary"))
    return rounded(found.join(off, "probe_set"))


@query()
def qc_components(spark, d):
    """Two components of all samples, with cells that are not finite at the mean."""
    odd = F.transform("values", lambda x, k: F.when((F.col("sample_id") + k) % 97 == 0, F.lit(float("nan"))).otherwise(x))
    rows = I.matrix(spark, d).select(F.lit(0).alias("fold"), F.col("sample_id").alias("id"), F.lit(True).alias("is_train"), odd.alias("x"))
    return models.pca(rows, 2)


_SCANNED = f", n AS (SELECT run, count(*) AS k FROM hist GROUP BY run), l AS (SELECT run, epoch, score AS v, run % 5 = 0 AS off, run % 7 = 0 AS uneven, run % 11 = 0 AS policy, run % 13 = 0 AS best FROM hist JOIN n USING (run) WHERE epoch = k) SELECT run::VARCHAR AS run, epoch AS best_epoch, CASE WHEN uneven OR policy THEN 'another policy' WHEN off OR best THEN 'scores disagree' END AS problem, {r('0.75 * v + CASE WHEN off THEN 1 ELSE 0 END')} AS score FROM l"


@query(sql(_SCANNED, "hist"))
def checkpoint_scan(spark, d):
    """What each run last validated; some have uneven series, another policy, or scores that are not what they are made of."""
    rows = I.history(spark, d).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "score"))).alias("h"))  # a run's epochs
    v, k = F.transform("h", lambda x: x["score"]), F.col("run")
    some = lambda c, m: F.when(k % m == 0, c[0]).otherwise(c[1])
    selection = F.transform("h", lambda x: x["score"] * 0.75 + some((F.lit(1.0), F.lit(0.0)), 5))
    half = F.transform(v, lambda x: x * 0.5)
    history = F.struct(v.alias("val_mse"), selection.alias("selection_score"), v.alias("first_mse"), some((F.slice(half, 1, F.greatest(F.size(half) - 1, F.lit(0))), half), 7).alias("second_mse"), v.alias("second_sd"), v.alias("val_r2"), v.alias("val_loss"), F.transform("h", lambda x: x["epoch"]).alias("val_epoch"))
    policy = F.struct(*(F.lit(x).alias(n) for n, x in checkpoints.POLICY.items()), F.lit(False).alias("uses_test"), F.lit(False).alias("uses_outcomes"), some((F.lit(0.4), F.lit(0.5)), 11).alias("first_weight"), F.lit(0.5).alias("second_weight"))
    best = F.element_at(selection, -1) + some((F.lit(0.25), F.lit(0.0)), 13)
    records = rows.select(k.cast("string").alias("run"), F.lit("").alias("path"), F.lit(0).cast("bigint").alias("epoch"), best.alias("best"), history.alias("history"), policy.alias("policy"))
    return rounded(checkpoints.scanned(records).select("run", "best_epoch", "problem", "score"))

"""Selections, projections and joins over samples, runs and reports that must fail rather than lose or repeat rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.functions import ids, vectors
from assaylake.operators import order
from assaylake.operators.contracts import ContractError, enforce, repeated
from assaylake.operators.qc import positions

#: Columns a sample's source dataset may stand in; the first that is filled for every sample counts.
LABELS = ("GSE", "canonical_GSE", "source_GSE", "split_group")


def optional_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Those of the wanted columns that there are, in the order wanted."""
    return df.select(*(F.col(f"`{c}`") for c in wanted if c in df.columns))


def variables(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c != key]


def eligible(runs: DataFrame, expected: DataFrame, completed: DataFrame, key: str = "run") -> DataFrame:
    """Runs that are expected and completed, in the columns of runs."""
    return runs.join(expected.select(key).distinct(), key, "left_semi").join(completed.select(key).distinct(), key, "left_semi")


def gather(rows: DataFrame, index: DataFrame, order: str = "ord") -> DataFrame:
    """The rows at index(at, order), as often and in the places the index says; a place beyond the table is an error."""
    found = index.select(F.col("at"), F.col(order).alias("_to")).join(rows.withColumnRenamed(order, "at").withColumn("_here", F.lit(True)), "at", "left")
    place = F.when(F.col("_here"), F.col("_to")).otherwise(F.raise_error(F.lit("the index names a row that is not there")).cast("bigint"))
    return found.withColumn(order, place).drop("at", "_to", "_here")


def with_accession(df: DataFrame, column: str, pattern: str = "^GSM[0-9]+$") -> DataFrame:
    return df.filter(F.upper(F.trim(F.col(column))).rlike(pattern))


def numeric_majority(cells: DataFrame, by: list[str], value: str = "value", share: float = 0.7, least: int = 3, spread: int = 10) -> DataFrame:
    """For each column of cells(by, value), texts: how many parse, whether it counts as numeric, and whether it has a histogram."""
    number = F.col(value).try_cast("double")
    out = cells.groupBy(*by).agg(F.count(value).alias("n"), F.count(number).alias("n_numeric"), F.countDistinct(number).alias("n_distinct"))
    numeric = F.col("n_numeric") >= F.greatest(F.lit(least), F.floor(share * F.col("n")))
    return out.withColumn("numeric", numeric).withColumn("histogram", numeric & (F.col("n_distinct") > spread))


def canonical_samples(df: DataFrame, sample: str, study: str, order: str, base: str) -> DataFrame:
    """Sample metadata under its canonical names with a link to each study, by matrix row."""
    link = ids.markdown_link(F.col("study"), ids.accession_url(F.col("study"), base))
    return df.select(F.trim(F.col(sample).cast("string")).alias("sample"), F.trim(F.col(study).cast("string")).alias("study"), F.col(order).cast("bigint").alias("matrix_row")).withColumn("link", link)


def joined_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", expected: int | None = None) -> DataFrame:
    """A join whose keys occur once on each side; otherwise, or with another number of rows than expected, an error."""
    for side, name in ((left, "left"), (right, "right")):
        enforce(repeated(side, keys), f"keys of the {name} side repeat")
    out = left.join(right, keys, how)
    if expected is not None and (n := out.count()) != expected:
        raise ContractError(f"{n} rows instead of {expected}")
    return out


def paired(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], names: tuple[str, str], expected: int | None = None) -> DataFrame:
    """Values of two tables side by side, under suffixes, for keys that both have once."""
    sides = [t.select(*keys, *(F.col(v).alias(f"{v}_{n}") for v in values)) for t, n in zip((a, b), names, strict=True)]
    return joined_one_to_one(sides[0], sides[1], keys, "inner", expected)


def earlier_and_final(final: DataFrame, earlier: DataFrame, key: str, mark: str) -> DataFrame:
    """final with the earlier results of its run, and whether both came from the same checkpoint: yes, or no-or-unknown."""
    old = earlier.select(key, *(F.col(c).alias(f"earlier_{c}") for c in earlier.columns if c != key))
    return final.join(old, key, "left").withColumn("checkpoint_match", F.when(F.col(mark) == F.col(f"earlier_{mark}"), "yes").otherwise("no-or-unknown"))


def spread(df: DataFrame, keys: list[str], by: list[str], most: int) -> DataFrame:
    """At most so many rows, evenly spread over the order of the first row of each key, with their `position` in it. Keys alone are put in order."""
    first = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")
    at = first.agg(positions(F.count(F.lit(1)), most).alias("at")).select(F.explode("at").alias("position"))
    places = order.numbered(first.select(*dict.fromkeys([*keys, *by])), [F.col(c) for c in by])
    places = places.join(F.broadcast(at), "position", "left_semi").select(*keys, "position")  # as many rows as asked for
    return first.join(F.broadcast(places), keys)


def pooled_values(rows: DataFrame, by: str, most_rows: int = 24, most_values: int = 600_000) -> DataFrame:
    """position, value: finite values of evenly spread rows, then evenly spread ones of these."""
    picked = spread(rows, [by], [by], most_rows).drop("position")
    values = picked.select(by, F.posexplode("values").alias("pos", "value")).filter(vectors.finite(F.col("value")))
    return spread(values, [by, "pos"], [by, "pos"], most_values).select("position", "value")


def in_all(sets: DataFrame, group: str, key: str, least: int = 3) -> DataFrame:
    """Keys that every group has; fewer than `least` are an error."""
    n = sets.agg(F.countDistinct(group).alias("groups"))
    found = sets.groupBy(key).agg(F.countDistinct(group).alias("groups")).join(F.broadcast(n), "groups", "left_semi").select(key)  # one row
    if (have := found.limit(least).count()) < least:
        raise ContractError(f"only {have} ids are in every {group}")
    return found


def comparison(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Report tables one under another with their protocol and an id that must be unique."""
    every = None
    for protocol, part in parts.items():
        named = part.withColumn("protocol", F.lit(protocol))
        every = named if every is None else every.unionByName(named, allowMissingColumns=True)
    every = every.withColumn("comparison_id", F.concat_ws(":", "protocol", *(F.col(k).cast("string") for k in keys)))
    enforce(repeated(every, ["comparison_id"]), "comparison ids repeat")
    return every


def dataset_labels(df: DataFrame, candidates: tuple[str, ...] = LABELS) -> str:
    """The first candidate column that has a value in every row."""
    have = [c for c in candidates if c in df.columns]
    empty = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in have)).first() if have else {}
    for c in have:
        if empty[c] == 0:
            return c
    raise ContractError(f"no column of {list(candidates)} is filled in every row")


def expected_and_observed(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct groups with whether they were expected and observed."""
    sides = [t.select(*keys).distinct().withColumn(n, F.lit(True)) for t, n in ((expected, "expected"), (observed, "observed"))]
    return sides[0].join(sides[1], keys, "full_outer").fillna(False, ["expected", "observed"])


def store_status(occurrences: DataFrame, sample: str, study: str, archives: DataFrame | None = None, validation: DataFrame | None = None) -> DataFrame:
    """One row: memberships, samples, memberships beyond one a sample, samples of several studies, studies.

    With archives(ok) also how many there are and are sound, and with validation(max_abs, rmse) the greatest difference and error found.
    """
    per = occurrences.groupBy(sample).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(study).alias("studies"))
    one = per.agg(F.sum("n").alias("memberships"), F.count(F.lit(1)).alias("samples"), F.count_if(F.col("studies") > 1).alias("multi_study"))
    one = one.withColumn("extra_memberships", F.col("memberships") - F.col("samples")).crossJoin(occurrences.agg(F.countDistinct(study).alias("studies")))
    if archives is not None:
        sound = F.lower(F.trim(F.col("ok").cast("string"))).isin("true", "1", "yes")
        one = one.crossJoin(archives.agg(F.count(F.lit(1)).alias("archives"), F.count_if(F.coalesce(sound, F.lit(False))).alias("sound_archives")))  # one row
    if validation is not None:
        one = one.crossJoin(validation.agg(F.max("max_abs").alias("max_abs"), F.max("rmse").alias("rmse")))  # one row
    return one


def reconstruction_totals(rows: DataFrame, by: list[str], target: str, prediction: str) -> DataFrame:
    """Sums of squared errors, elements, values and their squares of rows with vectors; the mean error and R2, of all elements, not of rows."""
    off = F.aggregate(F.zip_with(target, prediction, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    y, y2 = F.aggregate(target, F.lit(0.0), lambda s, x: s + x), F.aggregate(target, F.lit(0.0), lambda s, x: s + x * x)
    out = rows.groupBy(*by).agg(F.sum(off).alias("sse"), F.sum(F.size(target)).alias("n"), F.sum(y).alias("sum_y"), F.sum(y2).alias("sum_y2"))
    spread_ = F.col("sum_y2") - F.col("sum_y") * F.col("sum_y") / F.greatest(F.col("n"), F.lit(1))
    return out.withColumns({"mse": F.col("sse") / F.col("n"), "r2": F.when(spread_ > 0, 1 - F.col("sse") / spread_)})


def densities(values: DataFrame, kind: str, n_bins: int = 70, value: str = "value") -> DataFrame:
    """values(kind, value) on bins from the least to the greatest value of all kinds; the last bin holds its upper edge."""
    edges = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    found = values.crossJoin(F.broadcast(edges)).filter("hi > lo")  # one row
    found = found.withColumn("bin", F.least(F.lit(n_bins - 1), F.floor((F.col(value) - F.col("lo")) / width)).cast("int"))
    counts = found.groupBy(kind, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy(kind)) * width)).select(kind, "bin", "n", "density")


def best_encoders(runs: DataFrame, score: str = "score") -> DataFrame:
    """The runs to compare: the best of all, the best of another architecture, the best of each method; a path once, under its first label.

    runs(path, method, architecture, score); ties go to the smaller path.
    """
    def best(by: list[str]) -> DataFrame:
        return runs.groupBy(*by).agg(F.min(F.struct(F.col(score).alias("score"), "path", "method", "architecture")).alias("b")).select("b.*")

    top = best([]).withColumn("label", F.lit("overall")).withColumn("place", F.lit(0))
    other = runs.join(F.broadcast(top.select(F.col("architecture").alias("a"))), F.col("architecture") != F.col("a")).drop("a")  # one row
    other = other.agg(F.min(F.struct(F.col(score).alias("score"), "path", "method", "architecture")).alias("b")).filter("b IS NOT NULL").select("b.*")
    other = other.withColumn("label", F.lit("best_other_architecture")).withColumn("place", F.lit(1))
    each = best(["method"]).withColumn("label", F.concat(F.lit("best_"), ids.slug(F.col("method")))).withColumn("place", F.lit(2))
    every = top.unionByName(other).unionByName(each)
    return every.groupBy("path").agg(F.min(F.struct("place", "label", "score", "method", "architecture")).alias("b")).select("path", "b.label", "b.score", "b.method", "b.architecture")


def criteria_winners(path: DataFrame, criteria: tuple[str, ...] = ("aic", "bic")) -> DataFrame:
    """Of a path table(fit_id, path_index, ...): for each fit and criterion the row of the least value, the earlier of equals."""
    every = None
    for c in criteria:
        own = path.groupBy("fit_id").agg(F.min(F.struct(F.col(c).alias("value"), "path_index")).alias("b")).select("fit_id", F.lit(c).alias("criterion"), F.col("b.path_index").alias("path_index"), F.col("b.value").alias("value"))
        every = own if every is None else every.unionByName(own)
    return every


def assembled(metrics: DataFrame, choice: DataFrame, fixed: list[str], name: str = "winner_z") -> DataFrame:
    """Final rows of a nested design: in each fold the chosen candidate under one name, and the fixed candidates as they are.

    metrics(repeat, fold, model_id, ...), choice(repeat, fold, model_id): a fold without its chosen candidate is an error.
    """
    keys = ["repeat", "fold"]
    enforce(repeated(choice, keys), "a fold has more than one choice")
    enforce(choice.join(metrics, [*keys, "model_id"], "left_anti"), "chosen candidates lack metrics")
    won = metrics.join(choice, [*keys, "model_id"], "left_semi").withColumn("source_model", F.col("model_id")).withColumn("model_id", F.lit(name))
    return won.unionByName(metrics.filter(F.col("model_id").isin(fixed)).withColumn("source_model", F.col("model_id")))

"""Splits without leakage: study components, balanced assignment, donors, repeated and nested folds, sweep grids."""

from __future__ import annotations

import json
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.functions import ids
from assaylake.operators.contracts import enforce, repeated, wrong_labels
from assaylake.operators.order import ranged, running_sums
from assaylake.operators.selections import in_all
from assaylake.session import written

#: Bits of a hash by which ranks are counted, and components that are dealt to parts by search.
RANK_BITS, LARGEST = 12, 2000


def study_components(spark: SparkSession, occurrences: DataFrame, folder: str) -> DataFrame:
    """For each study of occurrences(sample, study): component, the smallest study that shared samples lead to.

    Each sample links its studies to its smallest; then studies take the smallest label around and labels jump to
    their own labels, written each round, until none changes. Rounds grow with the logarithm of the longest chain.
    """
    least = occurrences.groupBy("sample").agg(F.min("study").alias("least"))
    edges = occurrences.join(least, "sample").select(F.col("study").alias("u"), F.col("least").alias("v")).distinct()
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    both = put(both, "edges")
    labels = put(both.groupBy("u").agg(F.min("v").alias("c")), "labels-0")
    k = 0
    while True:
        k += 1
        around = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("n"))
        near = labels.join(around, "u").select("u", F.col("c").alias("old"), F.least("c", "n").alias("m"))
        jump = labels.select(F.col("u").alias("m"), F.col("c").alias("j"))
        after = put(near.join(jump, "m", "left").select("u", "old", F.least("m", F.coalesce("j", "m")).alias("c")), f"labels-{k}")
        if after.filter("old <> c").isEmpty():
            return after.select(F.col("u").alias("study"), F.col("c").alias("component"))
        labels = after.select("u", "c")


def balanced_assignment(sizes: dict[str, int], seed: int, train: float, validation: float, attempts: int = 2048) -> dict[str, str]:
    """Whole components to three parts near the fractions wanted: the best of many random greedy fillings.

    For a few hundred components on the driver; a part is filled while that brings it nearer its target.
    """
    test = 1.0 - train - validation
    if min(train, validation, test) <= 0:
        raise ValueError("all three fractions must be positive")
    if len(sizes) < 3:
        raise ValueError("at least three components are needed")
    names, weight = list(sizes), np.array(list(sizes.values()), float)
    total, least, rng = weight.sum(), weight.min(), np.random.default_rng(seed)
    best, best_score = None, np.inf
    for _ in range(max(128, attempts)):
        part = np.zeros(len(names), int)
        for label, share in ((1, validation), (2, test)):
            free = np.flatnonzero(part == 0)
            held = 0.0
            for k in rng.permutation(free).tolist():
                if least > 2 * (share * total - held) + 1e-6:
                    break  # none can bring it nearer
                if abs(held + weight[k] - share * total) < abs(held - share * total):
                    held += weight[k]
                    part[k] = label
            if held == 0 and len(free):
                part[free[np.abs(weight[free] - share * total).argmin()]] = label
        counts = [int((part == k).sum()) for k in range(3)]
        if min(counts) == 0:
            continue
        off = sum(abs(weight[part == k].sum() / total - share) for k, share in enumerate((train, validation, test)))
        score = off + 0.002 * (1 / counts[1] + 1 / counts[2])
        if score < best_score:
            best, best_score = part.copy(), score
    if best is None:
        raise ValueError("no assignment leaves every part a component")
    return {n: ("train", "validation", "test")[k] for n, k in zip(names, best, strict=True)}


def component_split(spark: SparkSession, samples: DataFrame, components: DataFrame, seed: int, train: float, validation: float) -> DataFrame:
    """samples(sample, study) with component and split.

    The LARGEST components are dealt by search. All others, each small beside a part, fill what the parts then lack of their shares, in a
    pseudo-random order and by running sums, so that only the largest ever meet on the driver.
    """
    joined = samples.join(components, "study", "left").withColumn("component", F.coalesce(F.col("component").cast("string"), F.concat(F.lit("UNGROUPED::"), F.col("sample").cast("string"))))
    sizes = written(spark, joined.groupBy("component").agg(F.countDistinct("sample").alias("n")), "component-sizes")
    largest = {r["component"]: r["n"] for r in sizes.orderBy(F.col("n").desc(), "component").limit(LARGEST).collect()}
    part = balanced_assignment(dict(sorted(largest.items())), seed, train, validation)
    table = spark.createDataFrame(sorted(part.items()), "component string, split string")
    rest = sizes.join(F.broadcast(table), "component", "left_anti")  # LARGEST rows
    total = sizes.agg(F.sum("n").alias("n")).first()["n"]
    held = {name: sum(n for c, n in largest.items() if part[c] == name) for name in ("validation", "test")}
    first = max(0.0, validation * total - held["validation"])
    second = first + max(0.0, (1.0 - train - validation) * total - held["test"])
    by = [F.xxhash64(F.lit(seed), "component"), F.col("component")]
    upto = running_sums(ranged(spark, rest, by, "component-rest"), by, {"upto": F.col("n")}, before=False)
    filled = upto.select("component", F.when(F.col("upto") <= first, "validation").when(F.col("upto") <= second, "test").otherwise("train").alias("split"))
    return joined.join(table.unionByName(filled), "component")


def summary(rows: DataFrame) -> DataFrame:
    """For each part of rows(sample, group, split, supervised): samples, their percentage, groups, and supervised samples."""
    total = rows.agg(F.countDistinct("sample").alias("_all"))  # one row
    out = rows.groupBy("split").agg(F.countDistinct("sample").alias("samples"), F.countDistinct("group").alias("groups"), F.countDistinct(F.when(F.col("supervised"), F.col("sample"))).alias("supervised"))
    return out.crossJoin(F.broadcast(total)).select("split", "samples", (F.col("samples") * 100.0 / F.col("_all")).alias("percent"), "groups", "supervised")


def roles(samples: DataFrame) -> DataFrame:
    """samples(donor, measured): measured is held out; not measured but of a measured donor is related; else eligible."""
    any_ = samples.groupBy("donor").agg(F.bool_or("measured").alias("donor_measured"))
    role = F.when(F.col("measured"), "held_out").when(F.col("donor_measured"), "related").otherwise("eligible")
    return samples.join(any_, "donor").withColumn("role", role)


def donor_split(donors: DataFrame, seed: int, fraction: float) -> DataFrame:
    """donors(donor, number, stratum): the first of each stratum in a pseudo-random order go to validation.

    As many as the fraction says, at least one and not all; a stratum of one donor stays in training.
    """
    scored = donors.withColumn("score", ids.donor_score(F.col("number"), seed))
    size = scored.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.when(F.col("n") < 2, 0).otherwise(F.least(F.greatest(F.bround(F.col("n") * fraction).cast("bigint"), F.lit(1)), F.col("n") - 1))
    ranked = scored.join(size, "stratum").withColumn("rank", F.row_number().over(W.partitionBy("stratum").orderBy("score", "donor")))
    return ranked.select("donor", "stratum", "score", F.when(F.col("rank") <= wanted, "validation").otherwise("train").alias("split"))


def donor_folds(donors: list[str], n_splits: int, n_repeats: int, seed: int) -> list[tuple[int, int, str]]:
    """(repeat, fold, donor): for a cohort of a few hundred, donors permuted by numpy's generator and cut into equal parts."""
    unique = np.unique(np.array(donors, str))
    if n_splits < 2 or n_splits > len(unique):
        raise ValueError("folds must be at least two and no more than the donors")
    out = []
    for repeat in range(n_repeats):
        order = np.random.default_rng(seed + repeat).permutation(unique)
        out += [(repeat, fold, str(d)) for fold, part in enumerate(np.array_split(order, n_splits)) for d in part]
    return out


def nested_manifest(donors: list[str], outer: int, repeats: int, inner: int, seed: int) -> list[tuple[int, int, str, str, str]]:
    """(repeat, fold, donor, outer role, inner role): each outer fold holds out one inner part of its own training donors."""
    out = []
    folds = donor_folds(donors, outer, repeats, seed)
    for repeat, fold in sorted({(r, f) for r, f, _ in folds}):
        test = {d for r, f, d in folds if (r, f) == (repeat, fold)}
        train = sorted({d for r, _, d in folds if r == repeat} - test)
        held = {d for _, f, d in donor_folds(train, inner, 1, seed + 100_003 + 1009 * repeat + 37 * fold) if f == 0}
        out += [(repeat, fold, d, "outer_train", "inner_validation" if d in held else "inner_train") for d in train]
        out += [(repeat, fold, d, "outer_test", "not_applicable") for d in sorted(test)]
    return out


def hashed_order(seed: Column, donor: str = "donor") -> Column:
    """A hash of the seed and the donor, a long of 63 bits that other engines find too: 52 bits of an MD5, followed by zeros."""
    digits = F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.col(donor).cast("string")).cast("binary")), 1, 13)
    return F.shiftleft(F.conv(digits, 16, 10).cast("bigint"), 11)


def part_of(rank: Column, n: Column, parts: int) -> Column:
    """The part, from 0, of the row with a rank, if n rows are cut into parts of which the first have one more."""
    size, more = F.floor(n / parts), F.pmod(n, F.lit(parts))
    return F.when(rank < more * (size + 1), F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")


def _ranked(df: DataFrame, by: list[str], seed: Column, hash_: Column | None = None) -> DataFrame:
    """df with rank, from 0 in each group, in the order of a hash of the seed and the donor.

    Ranks are counted in bins of the hash: a group's window has a row for each of 2^RANK_BITS bins, a bin's its share of the donors.
    """
    hashed = df.withColumn("hash", F.xxhash64(seed.cast("bigint"), "donor") if hash_ is None else hash_)
    hashed = hashed.withColumn("bin", F.shiftrightunsigned("hash", 64 - RANK_BITS))
    bins = hashed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(*by, "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy(*by, "bin").orderBy("hash", "donor")
    return hashed.join(bins, [*by, "bin"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1).drop("hash", "bin", "before")


def nested_manifest_of(donors: DataFrame, outer: int, repeats: int, inner: int, seed: int) -> DataFrame:
    """nested_manifest of any number of donors(donor), with parts of the same sizes; the order is that of hashed_order instead of numpy's generator."""
    donors = donors.select(F.col("donor").cast("string").alias("donor")).distinct()
    if not donors.filter("donor IS NULL").isEmpty():
        raise ValueError("donors cannot be missing")
    n = donors.count()
    if outer < 2 or outer > n or inner < 2 or inner > n - -(-n // outer):
        raise ValueError("folds must be at least two and no more than the donors")
    size, more = divmod(n, outer)  # the first folds have one more
    long = lambda x: F.lit(x).cast("bigint")
    rows = donors.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    own = long(seed) + F.col("repeat")
    rows = _ranked(rows, ["repeat"], own, hashed_order(own))
    own = F.when(F.col("rank") < more * (size + 1), F.floor(F.col("rank") / (size + 1))).otherwise(more + F.floor((F.col("rank") - more * (size + 1)) / size))
    rows = rows.select("repeat", "donor", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("fold"))
    names = ["repeat", "fold", "donor"]
    inside = long(seed + 100_003) + 1009 * F.col("repeat") + 37 * F.col("fold")
    train = _ranked(rows.filter("own <> fold").select(*names), ["repeat", "fold"], inside, hashed_order(inside))
    held = F.ceil((n - size - (F.col("fold") < more).cast("int")) / inner)
    train = train.select(*names, F.lit("outer_train").alias("outer_role"), F.when(F.col("rank") < held, "inner_validation").otherwise("inner_train").alias("inner_role"))
    test = rows.filter("own = fold").select(*names, F.lit("outer_test").alias("outer_role"), F.lit("not_applicable").alias("inner_role"))
    return train.unionByName(test)


def quantile_strata(df: DataFrame, column: str, n: int = 4) -> DataFrame:
    """Right-closed bins between quantiles, equal edges merged; a missing value counts as the median. Not ntile: ties stay together."""
    edges = df.agg(F.percentile(column, F.array(*(F.lit(k / n) for k in range(n + 1)))).alias("edges"), F.percentile(column, F.lit(0.5)).alias("median"))
    filled = df.crossJoin(F.broadcast(edges)).withColumn("filled", F.coalesce(column, "median"))  # one row
    inner = F.array_distinct("edges")
    stratum = F.greatest(F.size(F.filter(inner, lambda e: e < F.col("filled"))) - 1, F.lit(0))
    return filled.withColumn("stratum", stratum).drop("edges", "median", "filled")


def expand_sweep(spark: SparkSession, branches: dict[str, dict], fields: set[str], most: int = 10_000) -> DataFrame:
    """A numbered row for each combination of every branch: its fixed settings and its grid, in the order given."""
    rows = []
    for name, branch in branches.items():
        fixed, grid = branch.get("fixed", {}), branch.get("grid", {})
        if unknown := (set(fixed) | set(grid)) - fields:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        if twice := set(fixed) & set(grid):
            raise ValueError(f"both fixed and in the grid: {sorted(twice)}")
        rows += [(name, json.dumps(fixed | dict(zip(grid, values, strict=True)), sort_keys=True)) for values in product(*grid.values())]
    if len(rows) > most:
        raise ValueError(f"{len(rows)} runs are more than {most}")
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], "array_index bigint, branch string, settings string")


def candidate_grid(spark: SparkSession, weights: list[float], temperatures: list[float]) -> DataFrame:
    """One control and every weight with every temperature."""
    rows = [(0, "control", 0.0, 0.0)] + [(k + 1, f"w{ids.number_slug(w)}_t{ids.number_slug(t)}", w, t) for k, (w, t) in enumerate(product(weights, temperatures))]
    return spark.createDataFrame(rows, "candidate_order int, candidate_id string, weight double, temperature double")


def all_methods_split(spark: SparkSession, matrices: DataFrame, occurrences: DataFrame, components: DataFrame, supervised: DataFrame, seed: int, train: float, validation: float, metadata: DataFrame | None = None) -> DataFrame:
    """One split for matrices(method, sample) of all methods, on the samples that all have, with the supervised rows under it.

    supervised(sample, split, ...) has only train and validation. The columns of the study split and of metadata(sample, ...), a row a
    sample, are null on supervised rows, and those of supervised alone on the others.
    """
    enforce(wrong_labels(supervised, "split", {"train", "validation"}, False), "supervised rows have other parts")
    shared = in_all(matrices, "method", "sample")
    study = occurrences.join(shared, "sample", "left_semi").groupBy("sample").agg(F.min("study").alias("study"))
    split = component_split(spark, study, components, seed, train, validation).select("sample", "study", "component", "split")
    if metadata is not None:
        enforce(repeated(metadata, ["sample"]), "samples repeat in the metadata")
        split = split.join(metadata, "sample", "left")
    split = split.withColumn("seed", F.lit(seed))
    return split.withColumn("domain", F.lit("array")).unionByName(supervised.withColumn("domain", F.lit("supervised")), allowMissingColumns=True)


def combined_split_faults(saved: DataFrame, made: DataFrame) -> DataFrame:
    """How a saved split of all methods differs from the one made anew: sample, problem (identity, or the columns that differ)."""
    named = lambda df, side: df.select("sample", F.struct(*(F.col(c) for c in ("domain", "split", "component") if c in df.columns)).alias(side))
    faults = repeated(saved, ["sample"]).select("sample", F.lit("repeated").alias("problem"))
    both = named(saved.dropDuplicates(["sample"]), "a").join(named(made, "b"), "sample", "full_outer")
    identity = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unknown")
    other = F.concat_ws(",", *(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in ("domain", "split", "component") if c in saved.columns and c in made.columns))
    return faults.unionByName(both.select("sample", F.coalesce(identity, other).alias("problem")).filter("problem <> ''"))


def rows_of_split(split: DataFrame, index: DataFrame) -> DataFrame:
    """split(sample, split) with the matrix row of each sample of index(sample, matrix_row); a sample or a part without rows is an error."""
    enforce(repeated(split, ["sample"]), "samples repeat in the split")
    enforce(repeated(index, ["sample"]), "samples repeat in the index")
    enforce(split.join(index, "sample", "left_anti"), "samples of the split have no matrix row")
    enforce(wrong_labels(split, "split", {"train", "validation", "test"}, True), "parts are missing or unknown")
    return split.join(index, "sample")


def stratified_folds_of(donors: DataFrame, folds: int, repeats: int, seed: int) -> DataFrame:
    """repeat, donor, fold (both from 1) for any number of donors(donor, stratum).

    As stratified_folds, with a hash's order: donors of a stratum are dealt one after another, each stratum from the fold where the one before
    stopped; if a stratum has fewer donors than folds, all count as one.
    """
    twice = repeated(donors.select("donor", "stratum").distinct(), ["donor"])
    enforce(twice, "donors in more than one stratum")
    donors = donors.select("donor", F.coalesce(F.col("stratum").cast("string"), F.lit("")).alias("stratum")).distinct()
    counts = donors.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.min("n").alias("least"), F.sum("n").alias("n")).first()
    if not 2 <= folds <= (found["n"] or 0):
        raise ValueError("there must be two folds at least, and no more than donors")
    if found["least"] < folds:
        donors = donors.withColumn("stratum", F.lit(""))
        counts = donors.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    name = [F.col("stratum")]
    before = running_sums(ranged(donors.sparkSession, counts, name, "strata"), name, {"before": F.col("n")}, before=True).select("stratum", "before")
    rows = donors.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    own = F.lit(seed) + F.col("repeat")
    rows = _ranked(rows, ["repeat", "stratum"], own, hashed_order(own)).join(before, "stratum")
    # A repeat's folds are turned by a number of its own.
    turn = F.pmod(F.shiftrightunsigned(hashed_order(own, "repeat"), 11), F.lit(folds))
    return rows.select("repeat", "donor", (F.pmod(F.col("before") + F.col("rank") + turn, F.lit(folds)) + 1).cast("int").alias("fold"))


def stratified_folds(strata: dict[str, str], folds: int, repeats: int, seed: int) -> list[tuple[int, str, int]]:
    """(repeat, donor, fold) for a few hundred donors: strata spread evenly over folds if each has as many donors as folds, else donors at random.

    Donors of a stratum are dealt in random order, each stratum from the fold where the one before stopped, so that folds differ by
    one donor at most, in all and within each stratum.
    """
    if not 2 <= folds <= len(strata):
        raise ValueError("there must be two folds at least, and no more than donors")
    donors = sorted(strata)
    members = {s: [d for d in donors if strata[d] == s] for s in sorted(set(strata.values()))}
    if min(map(len, members.values())) < folds:
        members = {"": donors}
    rng, out = np.random.default_rng(seed), []
    for repeat in range(1, repeats + 1):
        dealt = [own[k] for own in members.values() for k in rng.permutation(len(own)).tolist()]
        names = rng.permutation(folds).tolist()
        out += [(repeat, d, names[k % folds] + 1) for k, d in enumerate(dealt)]
    return out

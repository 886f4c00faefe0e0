"""Mix sources to target weights by Pareto order sampling. DataFrame functions only.

Each source gets a target number of words: a share by its weight, at most `most` times what it has, the excess
given to the others by weight. A document is first taken as many whole times as target / size of its source
holds. Of what is left of the target, a document has the inclusion probability min(1, c times its size), with c
such that the expected words are what is left; those with probability 1 are taken, the others are ranked by random
odds divided by inclusion odds, and taken in that order up to what is left, to the nearest document. Long documents
thus come sooner; the fixed size of the sample is counted in words, which is what targets are given in.

Cases: a null text has size 0 and counts as of size 1 for its probability; a null source is a source of its own, the
last; a source without words has target 0 and its documents are taken 0 times; repeated rows count each by itself and,
having the same random number, stand together in the order; a document without a doc_id has its random number from its text;
an empty table gives an empty result; further columns, whatever their names, pass through `mixed` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.llm.common import n_words, partitions, ranged, running_sums, text_or_empty, unit_bits, whole_row, written

#: Bits of the random number, bins into which the order of a source is cut, and sources that are broadcast (60 bytes each) instead of joined.
BITS, BINS, FEW = 52, 1 << 14, 100_000


def targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row for each source: source, source_size, target.

    With the sources in order of cap / weight, the level that fills the total is the largest of (total less the
    caps before) / (weights from here on). Both orders are range partitioned, so many sources are no matter.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").asc_nulls_last()]
    per = running_sums(ranged(spark, per, by_name, "mix-sources"), by_name, {"rank": F.lit(1)}, before=True).drop("pid")
    each = F.array(*map(F.lit, weights))
    per = per.withColumn("weight", F.element_at(each, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = [F.col("ratio"), F.col("rank")]
    per = running_sums(ranged(spark, per, by_ratio, "mix-caps"), by_ratio, {"caps": F.col("cap"), "weights": F.col("weight")}, before=True)
    all_ = per.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("total_weight"))
    per = per.crossJoin(F.broadcast(all_))  # one row
    level = (F.col("total") - F.col("caps")) / (F.col("total_weight") - F.col("weights"))
    per = per.crossJoin(F.broadcast(per.agg(F.max(level).alias("level"))))  # one row
    filled = F.col("weight") * F.col("level")
    return per.select("source", "source_size", F.when(F.col("cap") <= filled, F.col("cap").cast("double")).otherwise(filled).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """Of each row of docs(doc_id, source, text): doc_id, source, size, source_size, target, copies, taken."""
    sizes = written(spark, docs.select("doc_id", "source", n_words(text_or_empty()).alias("size"), _key()), "mix-sizes")  # texts are read once
    per = targets(spark, sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    per = written(spark, per, "mix-sources")
    few = per.count() <= FEW  # a row for each source, as in all that is joined by source

    # Sizes from s on are certain if, with c = 1 / s, the expected words are no more than what is left. A row for each source and size.
    held = sizes.filter("size > 0").groupBy("source", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words")).withColumn("squares", F.col("words") * F.col("size"))
    down = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, 0)
    up = W.partitionBy("source").orderBy(F.col("size")).rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("from_here", F.sum("words").over(down)).withColumn("below", F.coalesce(F.sum("squares").over(up), F.lit(0)))
    held = _of_source(held, per.select("source", "rest"), few)
    certain = F.col("size") * F.col("from_here") + F.col("below") <= F.col("size") * F.col("rest")
    shares = held.groupBy("source").agg(
        F.min(F.when(certain, F.col("size"))).alias("certain_from"), F.sum(F.when(certain, F.col("words")).otherwise(0)).alias("sure"), F.sum(F.when(~certain, F.col("squares")).otherwise(0)).alias("unsure")
    )
    per = _of_source(per, shares, few).withColumn("c", F.when(F.col("unsure") > 0, (F.col("rest") - F.col("sure")) / F.col("unsure")))

    rows = _of_source(sizes, per, few).withColumn("bits", unit_bits(F.col("key"), seed))
    u = (F.col("bits") + 0.5) / float(1 << BITS)
    p = F.col("c") * F.greatest(F.col("size"), F.lit(1))
    rank = F.when(F.col("size") >= F.col("certain_from"), 0.0).when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p))).when(p >= 1, 0.0)  # null: never
    rows = rows.withColumn("rank", rank).withColumn("bin", F.when(F.col("rank") > 0, F.floor(F.col("rank") / (1 + F.col("rank")) * BINS)).when(F.col("rank") == 0, -1).cast("long"))

    # The bin in which what is left is reached: sums for each bin, then the rows of one bin of each source.
    bins = rows.filter("bin IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("held"), F.first("rest").alias("rest"))
    inside = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("held").over(inside)).withColumn("cut_before", F.col("upto") - F.col("held"))
    cut = bins.filter((F.col("cut_before") < F.col("rest")) & (F.col("upto") >= F.col("rest")) & (F.col("bin") >= 0)).select("source", F.col("bin").alias("cut_bin"), "cut_before")
    cut = cut.unionByName(bins.groupBy("source").agg(F.max("upto").alias("upto"), F.first("rest").alias("rest")).filter("upto < rest").select("source", F.lit(BINS).cast("long").alias("cut_bin"), F.lit(0).cast("long").alias("cut_before")))
    rows = _of_source(rows, cut, few)
    at = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    order = W.partitionBy("source").orderBy("rank", "bits", "key", "size").rowsBetween(W.unboundedPreceding, 0)
    near = F.col("cut_before") + F.sum("size").over(order) - F.col("size") / 2 <= F.col("rest")
    edge = rows.filter(at).withColumn("extra", near.cast("long"))
    others = rows.filter(~at).withColumn("extra", F.coalesce((F.col("rank") == 0) & (F.col("rest") > 0) | (F.col("bin") < F.col("cut_bin")), F.lit(False)).cast("long"))
    out = others.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key")


def _key() -> Column:
    """What a document's random number comes from: its doc_id, or else its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty())).alias("key")


def _of_source(rows: DataFrame, per: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of per(source, ...), a row or none for each source, whose null is a source.

    Few sources, by count, are broadcast. Others are joined on source and salt, so that a source's rows are in several tasks; the salt
    is a hash, the same when a lost task is run again.
    """
    per = per.withColumnRenamed("source", "_source")
    if few:
        return rows.join(F.broadcast(per), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    n = partitions(rows.sparkSession)
    per = per.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int"))
    return rows.join(per, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_part")), "left").drop("_source", "_salt", "_part")


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """docs, each row as many times as the mix takes it.

    Rows that agree in doc_id (without one, in text), source and size stand together in the order; if the cut falls among them, the
    first of them, by a hash of their other columns, are those taken once more. A row is carried whole, as one column.
    """
    keys = ["key", "source", "size"]
    copies = mix(spark, docs, weights, most).groupBy(*keys).agg(F.min("copies").alias("copies"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n")).filter("all > 0")
    copies = copies.select(*(F.col(k).alias(f"_{k}") for k in keys), "copies", (F.col("all") - F.col("n") * F.col("copies")).alias("more"))
    rows = docs.select(whole_row(docs), _key(), "source", n_words(text_or_empty()).alias("size"))
    met = (F.col("key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    rows = rows.join(copies, met).select("row", *keys, "copies", "more")
    cut = rows.filter("more > 0")  # one document's repeated rows for each source at most
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("row")))
    cut = cut.withColumn("copies", F.col("copies") + (nth <= F.col("more")).cast("long"))
    rows = rows.filter("more = 0").unionByName(cut).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CASE WHEN b = '' THEN 0 ELSE len(string_split_regex(b, '[\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix' || key), 1, 13))::BIGINT AS bits, key
  FROM (SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key, trim(coalesce(text, ''), e' \t\n\x0b\x0c\r') AS b FROM documents)),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS rk FROM p),
c AS (SELECT *, rk % 3 + 1 AS weight, 3 * source_size AS cap FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::BIGINT / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS lev
  FROM c WINDOW o AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap <= weight * m THEN cap::DOUBLE ELSE weight * m END AS target
  FROM (SELECT *, max(lev) OVER () AS m FROM l)),
r AS (SELECT s.doc_id, s.size, s.bits, s.key, t.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
z AS (SELECT source, size, any_value(target - whole * source_size) AS rest, count(*) * size AS words FROM r WHERE size > 0 GROUP BY source, size),
y AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY size DESC)::BIGINT AS from_here, coalesce(sum(words * size) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM z),
x AS (SELECT source, min(size) FILTER (WHERE sure) AS certain_from, CASE WHEN bool_or(NOT sure) THEN (any_value(rest) - coalesce(sum(words) FILTER (WHERE sure), 0)::BIGINT) / (sum(words * size) FILTER (WHERE NOT sure))::BIGINT END AS c
  FROM (SELECT *, size * from_here + below <= size * rest AS sure FROM y) GROUP BY source),
o AS (SELECT r.*, target - whole * source_size AS rest, (bits + 0.5) / 4503599627370496.0::DOUBLE AS u, c * greatest(size, 1) AS p, coalesce(size >= certain_from, false) AS sure
  FROM r LEFT JOIN x ON r.source IS NOT DISTINCT FROM x.source),
k AS (SELECT *, CASE WHEN sure OR p >= 1 THEN 0.0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rk FROM o)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rk IS NOT NULL AND rest > 0 AND sum(size) OVER o - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k WINDOW o AS (PARTITION BY source ORDER BY rk NULLS LAST, bits, key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

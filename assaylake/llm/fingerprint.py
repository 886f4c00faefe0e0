"""Document fingerprints by one-permutation MinHash. DataFrame functions only.

Each word shingle is hashed once; the hash's first bits name one of BINS bins, and a bin keeps the smallest hash. A bin without
a shingle takes that of the first bin that has one in its own order of bins: bin j tries (a_j t + c_j) mod BINS for t = 0, 1, ...,
with a_j odd, so that equal donors for two texts are as likely as their similarity (optimal densification). B low-order bits
of each bin are packed as hexadecimal digits. Of two texts with similarity s, a bin agrees with s + (1 - s) / 2^B; `likeness`
undoes that.

Cases: a null or empty text, or one without words, has an empty fingerprint: likeness 1 to another such and 0 to any other;
a text with fewer words than the width has one shingle. Rows that repeat a doc_id get a row each; as the next document of
others, the smallest beginning and the smallest fingerprint of its rows count. The last document's next is the first; a lone document is its own next. A null
doc_id comes first. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.llm.common import SPACE, ranged, text_or_empty, written

BINS, B, WIDTH = 128, 8, 5
DIGITS = B // 4


#: The last bits of a bin without a shingle; a bin is named by the first bits of a hash.
SHIFT = 64 - (BINS.bit_length() - 1)
EMPTY = (1 << SHIFT) - 1
LONGS = "array<bigint>"
#: Stages of tries of a bin's own order of bins: most bins find a donor early.
TRIES = (0, 8, 40, BINS)


def hashes(text: Column) -> Column:
    """A hash of each word, in order."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast(LONGS)).otherwise(F.transform(F.split(bare, SPACE), lambda w: F.xxhash64(w)))


def with_shingles(df: DataFrame, name: str, h: str, width: int, short: Column) -> DataFrame:
    """Add hashes of all runs of `width` word hashes of the column h; of a shorter array, where `short`, that of all.

    Runs double: those of two words from words, of four from two, and so on. Each step is a column of its own, so that it is
    computed once. Beyond the end zip_with puts nulls, and what they reach is cut off.
    """
    done, runs = 0, h
    made = []
    total = None
    for k in range(width.bit_length()):
        if k:
            made.append(f"_{name}{k}")
            after = F.slice(runs, (1 << (k - 1)) + 1, F.greatest(F.size(runs), F.lit(1)))
            df = df.withColumn(made[-1], F.zip_with(runs, after, lambda x, y: F.xxhash64(x, y)))
            runs = made[-1]
        if width >> k & 1:
            if total is None:
                total, done = runs, 1 << k
            else:
                made.append(f"_{name}_{k}")
                df = df.withColumn(made[-1], F.zip_with(runs, F.slice(total, (1 << k) + 1, F.greatest(F.size(total), F.lit(1))), lambda x, y: F.xxhash64(x, y)))
                total, done = made[-1], done + (1 << k)
    n = F.size(h)
    one = F.array(F.xxhash64(h))
    every = F.slice(total, F.lit(1), F.greatest(n - width + 1, F.lit(0)))
    return df.withColumn(name, F.when(n >= width, every).when(short & (n > 0), one).otherwise(F.array().cast(LONGS))).drop(*made)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_least(df: DataFrame, name: str, found: Column) -> DataFrame:
    """Add the smallest hash of each bin, an array of BINS longs in their order; EMPTY in its last bits where there is none.

    The sort is a column, not in a lambda, so that it is of a compiled array of longs.
    """
    none = F.array(*(F.lit(_signed((b << SHIFT) | EMPTY)) for b in range(BINS)))
    df = df.withColumn(f"_{name}", F.sort_array(F.concat(found, none)))
    other = lambda x, i: (i == 0) | (F.shiftrightunsigned(x.bitwiseXOR(F.get(f"_{name}", i - 1)), SHIFT) != 0)
    return df.withColumn(name, F.filter(f"_{name}", other)).drop(f"_{name}")


def _orders() -> list[list[int]]:
    """For each bin the bins it tries, in order: (a t + c) mod BINS with odd a."""
    drawn = random.Random(6)
    return [[(a * t + c) % BINS for t in range(BINS)] for a, c in ((2 * drawn.randrange(BINS // 2) + 1, drawn.randrange(BINS)) for _ in range(BINS))]


def densified(slots: Column) -> Column:
    """Slots with each empty one filled from its donor; null where all are empty."""
    empty = lambda x: x.bitwiseAND(F.lit(EMPTY)) == EMPTY
    orders = _orders()
    stages = [F.expr("array(" + ",".join(f"array({','.join(map(str, o[lo:hi]))})" for o in orders) + ")") for lo, hi in zip(TRIES, TRIES[1:], strict=False)]

    def donor(j: Column) -> Column:
        return F.coalesce(*(F.get(F.filter(F.transform(F.get(stage, j), lambda t: F.get(slots, t)), lambda x: ~empty(x)), F.lit(0)) for stage in stages))

    return F.when(F.exists(slots, lambda x: ~empty(x)), F.transform(slots, lambda x, j: F.when(empty(x), donor(j)).otherwise(x)))


def packed(slots: Column) -> Column:
    """B low-order bits of each bin as hexadecimal digits; empty for null."""
    digits = F.lit([f"{k:0{DIGITS}x}" for k in range(1 << B)])
    low = F.transform(slots, lambda x: F.get(digits, x.bitwiseAND(F.lit((1 << B) - 1)).cast("int")))
    return F.coalesce(F.array_join(low, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two packed fingerprints, 0 to 1."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, k: n + (F.substring(a, k * DIGITS + 1, F.lit(DIGITS)) == F.substring(b, k * DIGITS + 1, F.lit(DIGITS))).cast("int"))
    by_chance = 1.0 / (1 << B)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - by_chance) / (1 - by_chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(estimate)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, packed fingerprint."""
    rows = docs.select("doc_id", hashes(text_or_empty()).alias("h"))
    rows = with_least(with_shingles(rows, "s", "h", width, F.lit(True)), "slots", F.col("s"))
    return rows.select("doc_id", packed(densified(F.col("slots"))).alias("fingerprint"))


def fingerprints_of_edit(rows: DataFrame, text: str, kept: Column, edited: str, width: int = WIDTH) -> DataFrame:
    """Add `fingerprint` and `edited_fingerprint` of two texts whose first `kept` code points are the same.

    A bin is a minimum, so the bins of the words that both have, up to the last blank of what they share, are computed once and
    merged with those of each one's other words; the last width - 1 shared words go with these, for the shingles across the seam.
    """
    shared = F.substring(text, F.lit(1), kept)
    cut = F.length(F.substring_index(F.translate(shared, "\t\n\x0b\x0c\r", "     "), " ", -1))
    rows = rows.withColumn("_stem", kept - cut)
    part = lambda c, lo, n: hashes(F.substring(c, lo, n))
    rows = rows.withColumn("_h", part(text, F.lit(1), F.col("_stem")))
    last = F.slice("_h", F.greatest(F.size("_h") - (width - 2), F.lit(1)), F.lit(width - 1))
    rows = rows.withColumns({f"_t{k}": F.concat(last, part(c, F.col("_stem") + 1, F.length(c))) for k, c in enumerate((text, edited))})
    rows = with_least(with_shingles(rows, "_s", "_h", width, F.lit(False)), "_shared", F.col("_s"))
    for k, name in enumerate(("fingerprint", "edited_fingerprint")):
        rows = with_shingles(rows, f"_s{k}", f"_t{k}", width, F.size("_h") < width)
        rows = with_least(rows, f"_slots{k}", F.concat("_shared", f"_s{k}"))
        rows = rows.withColumn(name, packed(densified(F.col(f"_slots{k}"))))
    return rows.drop("_stem", "_h", "_t0", "_t1", "_s", "_s0", "_s1", "_shared", "_slots0", "_slots1")


def neighbours(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """For each distinct doc_id of ids(doc_id, n): the one before it, and a quarter of that one's greatest length. The first's is the last.

    Ids and lengths alone are put in order, in range partitions; between partitions, their last rows are enough.
    """
    order = F.col("doc_id").asc_nulls_first()
    ids = ranged(spark, ids.groupBy("doc_id").agg(F.max("n").alias("n")), [order], "fingerprint-ids").withColumn("row", F.struct("doc_id", "n"))
    ids = ids.withColumn("before", F.lag("row").over(W.partitionBy("pid").orderBy(order)))
    ends = ids.groupBy("pid").agg(F.max_by("row", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("last"))  # a row for each partition
    every = W.orderBy("pid")
    ends = ends.select("pid", F.coalesce(F.lag("last").over(every), F.last("last").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("ended"))
    ids = ids.join(F.broadcast(ends), "pid").withColumn("before", F.coalesce("before", "ended"))
    return ids.select("doc_id", F.col("before.doc_id").alias("before_id"), F.floor(F.col("before.n") / 4).cast("int").alias("quarter"))


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.select("doc_id", F.length(text_or_empty()).alias("n"))
    before = neighbours(spark, ids).select(_key("doc_id").alias("key"), _key("before_id").alias("of"), "quarter")
    # Texts are shuffled once, by key; the beginning that the document before borrows, and its key, follow them there.
    rows = docs.select(_key("doc_id").alias("key"), text_or_empty().alias("text"))
    lent = rows.join(before, "key").groupBy(F.col("of").alias("key"), F.col("key").alias("next")).agg(F.min(F.expr("substring(text, 1, quarter)")).alias("head"))
    both = rows.join(lent, "key").withColumn("n_chars", F.length("text"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - n_chars div 4)"), F.expr("substring(head, 1, cast(n_chars div 4 as int))")))
    both = fingerprints_of_edit(both, "text", F.expr("cast(n_chars - n_chars div 4 as int)"), "edited")
    both = written(spark, both.select("key", "next", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "fingerprints")
    nexts = both.groupBy(F.col("key").alias("next")).agg(F.min("fingerprint").alias("next_fingerprint"))
    out = both.join(nexts, "next").withColumn("doc_id", F.col("key").try_cast("long"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))

"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

A text's set is its distinct word shingles. Texts with equal sets form a class, which is linked at once. A class has a
signature of COMPONENTS minima, B_BITS of each. Signatures are split into chunks of CHUNK components, and each chunk is
looked up with every choice of ERRORS components left out. By the pigeonhole principle every two signatures that differ in
at most LARGEST components meet under some key; two sets of similarity 0.8 differ in more with a probability of 1e-6.

A key may hold very many classes, so not all its pairs are made:
1. Each class is compared with the smallest of its key; the pairs whose signatures are near enough are confirmed on the full
   sets, and the confirmed links give first components.
2. In keys that still hold more than one component, the classes are dealt into blocks of about BLOCK, and blocks are compared
   in pairs where their sizes allow a link. Each class is known by the shingles of the key's smallest that it has, as bits, and by slots of those it has beyond:
   that bounds every overlap, and closely. Pairs of different components with near signatures that the bound allows are confirmed too; pairs
   within a component add nothing.

Cases: a null or empty text, or one without words, has no shingles and is linked with nothing; a text with fewer words than
the width has one shingle, all its words; rows that repeat a doc_id get a row each, told apart by their texts, and classes with
the same smallest doc_id are linked; rows without words name themselves; a null doc_id names no component; an empty table gives
an empty result. Work tables are deleted after their last reader; the sketches and the result's tables are read lazily and stay.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import Work, partitions, whole_row, written
from assaylake.llm.components import components
from assaylake.llm.textvec import blocks, mix, shingle_sets

COMPONENTS, B_BITS, CHUNK, ERRORS, BLOCK = 48, 16, 4, 1, 256
#: With CHUNKS chunks of up to ERRORS errors each, a pair that differs in LARGEST components meets at least once.
CHUNKS = COMPONENTS // CHUNK
LARGEST = CHUNKS * (ERRORS + 1) - 1

_rng = np.random.default_rng(7)
_TIMES = (_rng.integers(0, 2**32, COMPONENTS, dtype=np.uint32) | np.uint32(1))[:, None]
_PLUS = _rng.integers(0, 2**32, COMPONENTS, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> bytes:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COMPONENTS, 2**32 - 1, np.uint32)
    for lo in range(0, len(low), 4096):
        least = np.minimum(least, ((low[lo : lo + 4096] ^ _PLUS) * _TIMES).min(axis=1))
    return (mix(least.astype(np.uint64)) & np.uint64((1 << B_BITS) - 1)).astype("<u2").tobytes()


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part, texts in blocks(batches):
        sets = shingle_sets(texts, width)
        keys = [_set_key(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "n_shingles", "set_key", "signature"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part, texts in blocks(batches, 0):
        sets = [x for x in (s.tobytes() for s in shingle_sets(texts, width)) if x]
        yield pa.RecordBatch.from_arrays([pa.array([_set_key(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "shingles"])


def _set_key(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


RELATED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("beyond", pa.int32()), ("held", pa.binary()), ("rest", pa.binary())])
RELATED_DDL = "a bigint, b bigint, linked boolean, beyond int, held binary, rest binary"
#: Slots into which the shingles beyond the key's first class are hashed, and sets that are compared with one copy of another.
SLOTS, TOGETHER = 2048, 512


def _relate(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, shingles) in which the set of a, with a null b, precedes those of its b: RELATED for each b.

    That is whether they are linked, how many shingles of b a lacks, which of a's, in order, b has, as bits, and the slots of those a lacks.
    """
    last, x = None, np.zeros(0, np.uint64)
    for batch in batches:
        rows = []
        for a, b, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            y = np.frombuffer(shingles.as_buffer(), np.uint64)
            if b is None:
                last, x = a, y.copy()
                continue
            if a != last:
                raise ValueError(f"the set of class {a} is missing")
            inside = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
            both = int(inside.sum())
            alone = y[x[np.minimum(np.searchsorted(x, y), len(x) - 1)] != y]
            rows.append((a, b, 100 * both >= percent * (len(x) + len(y) - both) > 0, len(y) - both, np.packbits(inside).tobytes(), (alone >> np.uint64(40)).astype("<u2").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RELATED, strict=True)], schema=RELATED)


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs of blocks of a key, the pairs of classes of different components that may be linked.

    Signatures must differ in at most LARGEST components, and the overlap can be enough: within the key's first class
    it is counted from the bits, beyond it is no more than the lesser of what the two have there.
    """
    for batch in batches:
        us, vs = [], []
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            a, b = (_members(x) for x in (left.values, right.values))
            width = max((len(x) for x in (*a["held"], *b["held"]) if x is not None), default=0)
            xa, xb = (_bits(x["held"], width) for x in (a, b))
            (na, ka), (nb, kb) = _slots(a), _slots(b)
            past = np.minimum(na @ (nb > 0).T.astype(np.float32), (na > 0).astype(np.float32) @ nb.T)
            past = np.where(ka[:, None] & kb[None], past, np.inf)
            most = xa @ xb.T + np.minimum(past, np.minimum(a["beyond"][:, None], b["beyond"][None]))
            most = np.minimum(most, np.minimum(a["n"][:, None], b["n"][None]))
            may = (a["component"][:, None] != b["component"][None]) & (100 * most >= percent * (a["n"][:, None] + b["n"][None] - most))
            i, j = np.nonzero(may)
            near = (a["signature"][i] != b["signature"][j]).sum(axis=1) <= LARGEST
            us.append(a["node"][i[near]])
            vs.append(b["node"][j[near]])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        found = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])


def _members(row: pa.StructArray) -> dict[str, np.ndarray | list]:
    out = {c: row.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for c, f in (("node", "node"), ("component", "component"), ("n", "n_shingles"), ("beyond", "beyond"))}
    out["held"], out["rest"] = row.field("held").to_pylist(), row.field("rest").to_pylist()
    out["signature"] = np.frombuffer(b"".join(row.field("signature").to_pylist()), "<u2").reshape(-1, COMPONENTS)
    return out


def _bits(held: list[bytes | None], width: int) -> np.ndarray:
    """A row of zeros and ones for each; all ones where nothing is known, as for the first class itself."""
    full = b"\xff" * width
    return np.unpackbits(np.frombuffer(b"".join(full if x is None else x.ljust(width, b"\x00") for x in held), np.uint8).reshape(len(held), width), axis=1).astype(np.float32)


def _slots(members: dict) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles beyond the first class each member has in each slot, and for which members that is known."""
    out = np.zeros((len(members["rest"]), SLOTS), np.float32)
    for k, x in enumerate(members["rest"]):
        if x:
            out[k] = np.bincount(np.frombuffer(x, "<u2") % SLOTS, minlength=SLOTS)
    return out, np.array([x is not None for x in members["rest"]]) | (members["beyond"] == 0)


def _keys() -> list:
    part = lambda c: F.substring("signature", 2 * c + 1, 2)
    return [F.xxhash64(F.lit(c * CHUNK + out), *(part(c * CHUNK + k) for k in range(CHUNK) if k != out)) for c in range(CHUNKS) for out in range(CHUNK)]


def _apart(a: str, b: str):
    return F.aggregate(F.sequence(F.lit(0), F.lit(COMPONENTS - 1)), F.lit(0), lambda n, k: n + (F.substring(a, 2 * k + 1, F.lit(2)) != F.substring(b, 2 * k + 1, F.lit(2))).cast("int"))


def _related(work: Work, sets: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) compared on their full sets, as RELATED. A pair moves the set of b alone; that of a goes once to every TOGETHER pairs."""
    of = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    dealt = pairs.join(of, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b", F.col("b").alias("node"))
    firsts = of.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    asked = dealt.unionByName(firsts).join(classes.select("node", "set_key"), "node").drop("node")
    rows = asked.join(sets, "set_key").select("a", "b", "shingles", "part").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return work.table(rows.select("a", "b", "shingles").mapInArrow(lambda x: _relate(x, percent), RELATED_DDL).dropDuplicates(["a", "b"]), "near-related")


def _linked(related: DataFrame) -> DataFrame:
    return related.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _open(keyed: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of keyed(key, node, first) in keys that hold more than one component, with n, the rows of the key."""
    held = keyed.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return keyed.join(open_.select("key", "n"), "key")


def _met(work: Work, keyed: DataFrame, components: DataFrame, classes: DataFrame, related: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks (l, r) of the classes in keys that hold more than one component.

    Classes of a key are dealt into bands by the logarithm of their size, so that sets that may be linked are in one band or in two
    neighbours; only blocks of these are paired, and none of a band that holds one component with each other.
    """
    known = classes.select("node", "n_shingles", "signature").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # The base is a little more than what the sizes of linked sets may differ by, so that rounding parts none by two bands.
    band = F.floor(F.log("n_shingles") / math.log(1.0001 * 100 / percent)).cast("int")
    dealt = _open(keyed, components).drop("n").join(known, "node").withColumn("band", band)
    counts = dealt.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), (F.min("component") < F.max("component")).alias("several"))
    dealt = dealt.join(counts, ["key", "band"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.join(related.select(F.col("a").alias("first"), F.col("b").alias("node"), "beyond", "held", "rest"), ["first", "node"], "left")
    dealt = dealt.withColumn("beyond", F.when(F.col("node") == F.col("first"), 0).otherwise(F.coalesce("beyond", "n_shingles")).cast("int"))
    dealt = dealt.groupBy("key", "band", "block", "blocks", "several").agg(F.collect_list(F.struct("node", "component", "n_shingles", "beyond", "held", "rest", "signature")).alias("members"))  # about BLOCK at most
    dealt = work.table(dealt, "near-blocks")
    left = dealt.filter("several").select("key", "band", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"), F.col("members").alias("l"))
    inside = left.join(dealt.select("key", "band", "block", F.col("members").alias("r")), ["key", "band", "block"]).select("l", "r")
    above = dealt.select("key", (F.col("band") + 1).alias("band"), F.col("members").alias("l")).join(dealt.select("key", "band", F.col("members").alias("r")), ["key", "band"])
    return inside.unionByName(above.select("l", "r"))


def near_groups(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    work = Work(spark)
    rows = written(spark, docs.mapInArrow(lambda x: _sketch(x, width), "doc_id bigint, n_shingles bigint, set_key binary, signature binary"), "near-sketches")
    classes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")).filter("doc IS NOT NULL")
    # Classes get ids of their own, in the order of their smallest doc_id: the first of a key is its oldest, which copies were made of.
    classes = classes.repartitionByRange(partitions(spark), "doc", "set_key").sortWithinPartitions("doc", "set_key")
    classes = written(spark, classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    signatures = classes.select("node", "signature")

    keyed = signatures.select("node", F.explode(F.array(*_keys())).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    keyed = work.table(keyed.join(shared, "key"), "near-keys")

    # The sets of the classes that share a key are made once, for all that is confirmed on them.
    wanted = classes.join(keyed.select("node").distinct(), "node", "left_semi").select(F.col("doc").alias("doc_id")).distinct()
    sets = work.table(docs.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(lambda x: _sets(x, width), "set_key binary, shingles binary"), "near-sets")

    pairs = keyed.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    sides = [signatures.select(F.col("node").alias(c), F.col("signature").alias(f"s{c}")) for c in "ab"]
    pairs = work.table(pairs.join(sides[0], "a").join(sides[1], "b").filter(_apart("sa", "sb") <= LARGEST).select("a", "b"), "near-pairs")
    related = _related(work, sets, classes, pairs, percent)
    first = work.table(components(spark, _linked(related)), "near-components")

    # Classes that are open but far from the first of their key are compared with it too: unrelated, they would stay unbounded.
    far = work.table(_open(keyed, first).filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "near-far")
    related = related.unionByName(_related(work, sets, classes, far, percent))
    more = _met(work, keyed, first, classes, related, percent).mapInArrow(lambda x: _near(x, percent), "a bigint, b bigint").distinct().join(pairs, ["a", "b"], "left_anti")
    more = work.table(more, "near-more")
    twins = classes.groupBy("doc").agg(F.min("node").alias("u"), F.collect_set("node").alias("all")).filter(F.size("all") > 1).select("u", F.explode("all").alias("v"))  # texts of one doc_id
    links = _linked(related).unionByName(_linked(_related(work, sets, classes, more, percent))).unionByName(twins)
    final = written(spark, components(spark, links), "near-components")
    work.discard()

    of = final.join(classes.select("node", "doc"), "node")
    named = of.join(of.groupBy("component").agg(F.min("doc").alias("component_id")), "component").select("node", "component_id")
    named = classes.join(named, "node", "left").select("set_key", F.coalesce("component_id", "doc").alias("component"))
    out = rows.join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each group; without a doc_id all do.

    Of rows that repeat a doc_id and a text one stays; where texts of a doc_id differ, each is a document of its own.
    """
    row = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.col("doc_id").cast("long").alias("node"), "text")
    named = row.filter("id IS NOT NULL")
    several = named.groupBy("id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).filter("lo < hi").select("id")
    several = written(spark, several, "near-several")
    if not several.isEmpty():
        key = F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")
        top = named.agg(F.max("id")).first()[0]
        own = named.join(several, "id", "left_semi").select("id", key).distinct()
        own = written(spark, own.withColumn("own", F.lit(top + 1) + F.monotonically_increasing_id()), "near-own")
        named = named.withColumn("key", key).join(own, ["id", "key"], "left").select("row", "id", F.coalesce("own", "node").alias("node"), "text")
    stay = near_groups(spark, named.select(F.col("node").alias("doc_id"), "text"), width, percent).filter("kept").select(F.col("doc_id").alias("node")).distinct()
    named = named.join(stay, "node", "left_semi").dropDuplicates(["node"])
    return named.select("row.*").unionByName(row.filter("id IS NULL").select("row.*"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * same >= 80 * (na.n + nb.n - same)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS c FROM n UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u WHERE r.c < e.v),
c AS (SELECT u, min(c) AS c FROM r GROUP BY u)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN c ON c.u = doc_id
"""

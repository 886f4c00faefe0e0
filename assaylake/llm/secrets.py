"""Secret scans over an incremental blob ledger. DataFrame functions only.

A blob is a distinct text under its SHA-256. The ledger, a table in a folder, has a row for each scan of a blob: the
rule versions scanned and the spans found. A run scans only the (blob, rule version) pairs that no row has, appends
them, and joins the spans of each blob back to every row that has the text. A rule's version is a digest of its
definition, so a changed rule scans every blob anew for that rule alone.

Cases: a null text counts as empty; repeated rows and copies share one scan and get a result each; an empty table
gives an empty result; a text without a match has zero counts and empty spans; columns other than the key and the
text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import text_or_empty, work_path


@dataclass(frozen=True)
class Rule:
    """All leftmost, non-overlapping matches of a pattern whose group has at least so many code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"


#: Base rules first, in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # Of a maximal run too short, no later part is long enough: the pattern may ask for the length itself.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE + MORE

#: With no more unseen blobs than this (40 bytes each), their ids are broadcast so that only their texts move.
FEW_UNSEEN = 100_000

FOUND = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def _running(steps: Column, n: Column) -> Column:
    """Running sums of an array of n > 0 numbers: each round adds what stands 1, 2, 4, ... places before."""
    rounds = F.ceil(F.log2(n)).cast("int")
    # The filter leaves nothing of a sequence that would run down to -1.
    return F.aggregate(F.filter(F.sequence(F.lit(0), rounds), lambda k: k < rounds), steps, lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2.0), k).cast("int")), F.lit(0))))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans of a text, as FOUND. A match ends at the running length of what lies between matches and of matches."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    none = F.array().cast(FOUND)

    def located(x: Column) -> Column:
        steps = F.transform(x["hits"], lambda h, i: F.length(F.get(x["between"], i)) + F.length(h))
        found = F.transform(_running(steps, F.size(x["hits"])), lambda stop, i: F.when(F.length(F.get(x["values"], i)) >= rule.least, F.struct((stop - F.length(F.get(x["hits"], i))).alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))))
        return F.filter(found, lambda s: s.isNotNull())

    # Arrays of one element bind a value to a name, so that each pattern runs once over a text.
    matched = F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, F.struct(h.alias("hits"), (values if rule.group else h).alias("values"), F.split(text, rule.pattern, -1).alias("between"))))
    return F.get(F.transform(matched, lambda x: F.when(x.isNull(), none).otherwise(located(x))), F.lit(0))


def scan(spark: SparkSession, versions: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with versions(key, text), and return key, blob, found for each row."""
    rows = versions.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).withColumn("blob", F.sha2(F.col("text"), 256))
    every = F.array(*(F.lit(r.version) for r in rules))
    known = _ledger(spark, ledger)
    if known is not None:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rule_versions"))).alias("seen"))  # a list as long as the rules scanned
        todo = rows.select("blob").distinct().join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0).select("blob", "todo")
        unseen = todo.limit(FEW_UNSEEN + 1).count()
        texts = rows.select("blob", "text")
        if unseen <= FEW_UNSEEN:
            blobs = texts.join(F.broadcast(todo), "blob").dropDuplicates(["blob"])
        else:
            blobs = texts.dropDuplicates(["blob"]).join(todo, "blob")
    else:
        blobs = rows.select("blob", "text").dropDuplicates(["blob"]).withColumn("todo", every)
    found = F.concat(*(F.when(F.array_contains("todo", r.version), _spans(F.col("text"), r, k)).otherwise(F.array().cast(FOUND)) for k, r in enumerate(rules)))
    blobs.select("blob", F.col("todo").alias("rule_versions"), found.cast(FOUND).alias("found")).write.mode("append").parquet(ledger)

    current = F.array(*(F.lit(r.version) for r in rules))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    scans = _ledger(spark, ledger).filter(F.arrays_overlap("rule_versions", current))
    # Spans count only where they come from the rule's present version.
    fresh = F.transform(F.filter("rule_versions", lambda v: F.array_contains(current, v)), lambda v: F.split_part(v, F.lit("@"), F.lit(1)))
    scans = scans.withColumn("fresh", fresh).select("blob", F.filter("found", lambda s: F.array_contains("fresh", s["kind"]) & F.array_contains(kinds, s["kind"])).alias("found"))
    scans = scans.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("all"))  # a list as long as the rules scanned
    scans = scans.select("blob", F.filter("all", lambda s, i: (i == 0) | (s != F.get("all", i - 1))).alias("found"))
    return rows.select("key", "blob").join(scans, "blob").select(F.col("key").alias(key), "blob", "found")


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(f"blob string, rule_versions array<string>, found {FOUND}").parquet(path)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(spark, docs, work_path(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    n = [count(r.kind).alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *n, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    either = "".join
    words = "|".join(either(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"""({words})["''']?\\x20*[:=]\\x20*["''']?([A-Za-z0-9+/_.=-]+)""".replace("'''", "''")
    patterns = [("assign", assign, 2, 8), *((r.kind, r.pattern, r.group, r.least) for r in RULES[1:])]
    found = []
    for k, (kind, pattern, group, least) in enumerate(patterns):
        found.append(f"""list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'s': (list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0))::BIGINT, 'k': {k}, 'e': (list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + list_sum(list_transform(m{k}[1:i], lambda x: length(x))))::BIGINT, 'n': '{kind}', 'ok': length(g{k}[i]) >= {least}}}), lambda s: s.ok)""")
    cols = ", ".join(f"regexp_extract_all(t, '{p}', 0) AS m{k}, regexp_extract_all(t, '{p}', {g}) AS g{k}, string_split_regex(t, '{p}') AS p{k}" for k, (_, p, g, _) in enumerate(patterns))
    text = "array_to_string(list_transform({}, lambda s: s.n || ':' || s.s || ':' || s.e), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {cols} FROM d),
f AS (SELECT doc_id, list_sort({" || ".join(found)}) AS f FROM m)
SELECT doc_id, {", ".join(f"len(list_filter(f, lambda s: s.k = {k}))::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE))},
  sha256({text.format("list_filter(f, lambda s: s.k < 3)")}) AS base_sha256, {text.format("f")} AS spans FROM f
"""


ORACLE = _oracle()

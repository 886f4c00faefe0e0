"""Language identification: script ranges, scores of words, and Viterbi with a switching penalty.

A word is a run of letters. Its letters' script narrows the languages to those that were seen to use it; each of them
scores the word by the log-probabilities of its letter trigrams (with its ends), less the mean over candidates. Viterbi
finds for the words of a text the best sequence of languages, where each change costs SWITCH; runs of one language are
the spans. The text's language is that of most letters, and the score its share of the letters.

Trigram counts come, in one task of an executor, from at most SAMPLE texts of each language, those with the smallest hashes of
their doc_id and at most LONGEST code points, ROWS texts and CHARS code points in all, of which each language has its share;
near copies are left out. The languages are the distinct labels,
however many: the table has at most 2^TABLE_BITS entries, so that with very many languages trigrams share buckets.

Cases: a null text, or one without a letter, is `und` with score 0; words of a script that no language uses score nothing and
go with their neighbours; without any label all texts are `und`; equal scores go to the first language in order; repeated
rows are labelled each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.llm import learn
from assaylake.llm.learn import LONGEST, char_hash, fitted, held_out, letters, lower, novel, texts_of
from assaylake.llm.textvec import blocks, codes, mix, spans

SAMPLE, BITS, LEAST_BITS, TABLE_BITS, SWITCH = 400, 16, 10, 24, 12.0
#: Rows of the sample for all languages together.
ROWS = 20_000
#: Word scores (words x languages) that are decoded together.
TOGETHER = 16_000_000
#: First code points of ranges of scripts; the rest up to the first is Latin, as is what no range names.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF00, "latin"), (0x10000, "other"), (0x20000, "han"),
)
NAMES = sorted({name for _, name in SCRIPTS})
SPANS = "array<struct<start:int,stop:int,lang:string>>"


@cache
def scripts() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for first, name in SCRIPTS:
        out[first:] = NAMES.index(name)
    return out


@dataclass
class Model:
    languages: list[str]
    bits: int
    table: np.ndarray  # 2^bits x languages
    uses: np.ndarray  # scripts x languages, whether a language uses a script


def word_trigrams(texts: list[str], bits: int):
    """Buckets of the letters' trigrams, word starts and ends among them, each word's script, starts, ends, and the texts' first words."""
    raw, at = codes(texts)
    inside = letters()[raw]
    starts, ends = spans(inside)
    h = np.where(inside, char_hash()[lower()[raw]], np.uint64(7))
    before, after = np.roll(h, 1), np.roll(h, -1)
    grams = mix(before * np.uint64(3) + h * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F))[inside] >> np.uint64(64 - bits)
    letters_before = np.concatenate([[0], np.cumsum(ends - starts)])
    return grams.astype(np.int64), letters_before, scripts()[raw[starts]], starts, ends, np.searchsorted(starts, at), at


def word_scores(model: Model, texts: list[str]):
    grams, bounds, script, starts, ends, first, at = word_trigrams(texts, model.bits)
    if not len(starts):
        return np.zeros((0, len(model.languages)), np.float32), starts, ends, first, at
    scores = np.stack([np.add.reduceat(model.table[:, k][grams], bounds[:-1]) for k in range(len(model.languages))], axis=1)
    allowed = model.uses[script]
    scores = np.where(allowed, scores, -1e3)
    scores[~allowed.any(axis=1)] = 0
    return (scores - scores.max(axis=1, keepdims=True)).astype(np.float32), starts, ends, first, at


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, for texts that stand one after another; all texts take each step together."""
    if not len(scores):
        return np.zeros(0, np.uint16)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = (len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), "right")).tolist()
    came = np.zeros(len(scores), np.uint16)  # the best language one word before
    moved = np.zeros(scores.shape, bool)  # whether coming from it beats staying
    v = scores[starts[: alive[0]]].astype(np.float64)
    last = np.zeros(len(lengths), np.uint16)
    for k in range(1, len(alive)):
        n = alive[k]
        if n < len(v):
            last[n : len(v)] = v[n:].argmax(axis=1)
            v = v[:n]
        at = starts[:n] + k
        best = v.argmax(axis=1)
        v = v - v[np.arange(n), best][:, None]
        jump = v < -switch
        came[at], moved[at] = best, jump
        v = np.where(jump, -switch, v) + scores[at]
    last[: len(v)] = v.argmax(axis=1)
    path = np.zeros(len(scores), np.uint16)
    state = last
    for k in range(len(alive) - 1, -1, -1):
        n = alive[k]
        at = starts[:n] + k
        path[at] = state[:n]
        state[:n] = np.where(moved[at, state[:n]], came[at], state[:n])
    return path


def _label(batches: Iterator[pa.RecordBatch], model: Model, with_spans: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        scores = np.concatenate([h[1] for h in held])
        counts = np.concatenate([np.diff(h[4]) for h in held])
        path = viterbi(scores, counts)
        weight = np.concatenate([h[3] - h[2] for h in held]).astype(np.float64)
        n, langs = len(counts), len(model.languages)
        mass = np.bincount(np.repeat(np.arange(n), counts) * langs + path, weight, n * langs).reshape(n, langs)
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        none = total == 0
        score = np.where(none, 0.0, mass[np.arange(n), best] / np.maximum(total, 1))
        names = np.array([*model.languages, "und"], object)[np.where(none, langs, best)]
        out = [pa.concat_arrays([h[0] for h in held]), pa.array(names, pa.string()), pa.array(score)]
        if with_spans:
            begin = np.concatenate([h[2] - np.repeat(h[5][:-1], np.diff(h[4])) for h in held])
            stop = np.concatenate([h[3] - np.repeat(h[5][:-1], np.diff(h[4])) for h in held])
            doc = np.repeat(np.arange(n), counts)
            opens = np.flatnonzero((np.diff(path.astype(np.int64), prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            closes = np.append(opens[1:], len(path))[: len(opens)] - 1
            named = pa.array(model.languages, pa.string()).take(pa.array(path[opens], pa.int32()))
            runs = pa.StructArray.from_arrays([pa.array(begin[opens], pa.int32()), pa.array(stop[closes], pa.int32()), named], names=["start", "stop", "lang"])
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[opens], np.arange(n + 1)), pa.int32()), runs))
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    for part, texts in blocks(batches):
        scores, starts, ends, first, at = word_scores(model, texts)
        held.append((part.column(0), scores, starts, ends, first, at))
        size += scores.size
        if size > TOGETHER:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def fit(docs: DataFrame, n: int = SAMPLE) -> Model:
    """Learn from docs(doc_id, text, lang); the caller leaves out what must not be learned from."""
    rows = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))  # a row for each language, as the model has
    several = max(1, counts.count())
    n, most = max(1, min(n, ROWS // several)), min(LONGEST, learn.CHARS // several)  # each language has its share of rows and of code points
    short = rows.filter(F.length("text") <= most)
    # Of a language with very many documents those with small hashes alone are put in order, twice as many as are wanted.
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 52))
    few = short.select("doc_id", "lang").join(F.broadcast(counts), "lang").filter(hashed < F.lit(float(1 << 52)) * (2 * n + 20) / F.col("held")).select("doc_id", "lang").distinct()
    ids = few.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(hashed, "doc_id"))).filter(F.col("nth") <= n).select("doc_id", "lang")
    texts = texts_of(short.drop("lang"), ids, ["lang"]).withColumn("upto", F.sum(F.length("text")).over(W.partitionBy("lang").orderBy(hashed, "doc_id", "text").rowsBetween(W.unboundedPreceding, 0)))
    languages = counts.select(F.lit(None).cast("long").alias("doc_id"), "lang", F.lit("").alias("text"))  # those whose texts are all too long count, too
    return fitted(texts.filter(F.col("upto") <= learn.CHARS // several).drop("upto").unionByName(languages), _fit)


def _fit(found: pd.DataFrame) -> Model:
    languages = sorted(found["lang"].unique().tolist())
    bits = max(LEAST_BITS, min(BITS, TABLE_BITS - max(0, len(languages) - 1).bit_length()))
    table = np.full((1 << bits, len(languages)), 0.02, np.float32)
    uses = np.zeros((len(NAMES), len(languages)), bool)
    for k, lang in enumerate(languages):
        texts = found["text"][found["lang"] == lang].tolist()
        texts = [t for t, new in zip(texts, novel(texts), strict=True) if new]
        grams, bounds, script, *_ = word_trigrams(texts, bits)
        table[:, k] += np.bincount(grams, minlength=1 << bits)
        share = np.bincount(script, minlength=len(NAMES)) / max(1, len(script))
        uses[:, k] = share >= 0.001
        table[:, k] = np.log(table[:, k] / table[:, k].sum(dtype=np.float64))
    return Model(languages, bits, table, uses)


def label(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and, if asked, the spans (start, stop in code points, lang)."""
    if not model.languages:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *([F.array().cast(SPANS).alias("spans")] if with_spans else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 4 << TABLE_BITS bytes
    kind = "doc_id bigint, lang_pred string, score double" + f", spans {SPANS}" * with_spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda x: _label(x, shared.value, with_spans), kind)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = label(docs, fit(docs.filter(~held_out(4, 2))), with_spans=True)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "spans")

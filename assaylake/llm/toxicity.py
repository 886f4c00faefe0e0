"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The labels are of documents; the tokens' labels for training are derived from them: a token of a toxic document is toxic
if one of its features (the word, its first 4 or 5 letters, its last 4) is in far more toxic than clean documents of the
sample, or is so often, and surely so. The field has two states and one chain for each sentence. Forward-backward gives each token's marginal; a
document's score is a logistic function of how many tokens are likelier toxic than not, how sure the surest is, and their
share, fitted on the documents' labels at their prevalence.

The model is fitted, in one task of an executor, on at most SAMPLE toxic and SAMPLE other documents, those with the smallest
hashes of their doc_id and at most LONGEST code points, CHARS in all (learn.py); near copies within the sample are left out.

Cases: a null or empty text, or one without letters, has no token and the score of a text without toxic tokens; repeated
rows are scored each; labels that are null or repeated count not at all or once; without labels of both kinds every score
is the prevalence (0 without labels); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.learn import Adam, char_hash, fit_logistic, fitted, grouped, held_out, letters, logistic, lower, novel, sample
from assaylake.llm.textvec import blocks, codes, mix, powers, release, spans

SAMPLE, BITS, EPOCHS, STRONG, SURE = 1500, 18, 25, 8.0, 3
#: Occurrences in a document from which a feature counts as there.
OFTEN = (1, 2, 4)
TOXIC = 0.7
#: Sentences end at these and at line ends.
ENDS = np.array([ord(c) for c in ".!?\n\r"], np.uint32)


def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (tokens x 4, buckets), token starts and ends among all code points, first token of each text, of each sentence."""
    raw, at = codes(texts)
    c = lower()[raw]
    inside = letters()[raw]
    starts, ends = spans(inside)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros((0, 4), np.int64), starts, ends, first, np.zeros(0, np.int64)
    h = char_hash()[c]
    run = np.zeros(len(c), np.int64)
    run[starts] = starts
    pos = np.arange(len(c)) - np.maximum.accumulate(run)
    terms = np.where(inside, h * powers(int((ends - starts).max()) + 1)[np.where(inside, pos, 0)], np.uint64(0))
    word = mix(np.add.reduceat(terms, starts))

    def part(offset: np.ndarray, n: int, salt: int) -> np.ndarray:
        out = np.full(len(starts), salt, np.uint64)
        for k in range(n):
            where = np.minimum(offset + k, len(c) - 1)
            ok = (where >= starts) & (where < ends)
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(ok, h[where], np.uint64(0))
        return mix(out)

    found = np.stack([word, part(starts, 4, 1), part(starts, 5, 2), part(ends - 4, 4, 3)], axis=1)
    stops = np.concatenate([[0], np.cumsum(np.isin(raw, ENDS))])
    sentence = stops[starts]
    new = np.flatnonzero(np.diff(sentence, prepend=-1) != 0)
    return (found >> np.uint64(64 - BITS)).astype(np.int64), starts, ends, first, new


def chains(begins: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """The chains' starts, longest first, and how many are longer than 0, 1, 2 ... tokens."""
    lengths = np.diff(np.append(begins, n))
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
    return begins[order], alive.tolist()


def marginals(u: np.ndarray, move: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token, and forward and backward odds. u: log odds of a token by itself; move: log weights of transitions."""
    t = np.exp(move)
    e = np.exp(np.clip(u, -30, 30))
    forth, back = e.copy(), np.ones(len(u))
    starts, alive = chains(begins, len(u))
    for k in range(1, len(alive)):
        at = starts[: alive[k]] + k
        r = forth[at - 1]
        forth[at] = e[at] * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)
    for k in range(len(alive) - 1, 0, -1):
        at = starts[: alive[k]] + k
        s = e[at] * back[at]
        back[at - 1] = (t[1, 0] + t[1, 1] * s) / (t[0, 0] + t[0, 1] * s)
    odds = forth * back
    return odds / (1 + odds), forth, back


@dataclass
class Field:
    weights: np.ndarray  # of 2^BITS buckets
    bias: float
    move: np.ndarray  # 2 x 2
    score: np.ndarray  # of the document's features

    def tokens(self, features: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return marginals(self.weights[features].sum(axis=1) + self.bias, self.move, begins)[0]


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: how many tokens are likelier toxic, the surest token, their share."""
    n = np.diff(first)
    likely = np.concatenate([[0], np.cumsum(p > 0.5)])
    count = likely[first[1:]] - likely[first[:-1]]
    most = np.zeros(len(n))
    full = n > 0
    if full.any():
        most[full] = np.maximum.reduceat(p, first[:-1][full])
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log1p(count), np.log(most / (1 - most)) / 4, np.sqrt(count / np.maximum(n, 1))])


def _telling(doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one feature of each token: the (document, value) it belongs to, how surely each tells toxic documents, and how many values there are.

    A value may tell by being in a document, or by being there often. What is less than STRONG times likelier there tells nothing.
    """
    n0, n1 = (toxic == 0).sum(), (toxic == 1).sum()
    q = n1 / (n0 + n1)
    cells, back_to, times = np.unique(doc * size + feature, return_inverse=True, return_counts=True)
    in_toxic, of = toxic[cells // size] == 1, cells % size
    evidence, tried = np.full(len(cells), -np.inf), 0
    for least in OFTEN:
        enough = times >= least
        with_ = [np.bincount(of[enough & (in_toxic == k)], minlength=size) for k in (False, True)]
        odds = ((with_[1] + 0.5) / (n1 + 1)) / ((with_[0] + 0.5) / (n0 + 1))
        n = np.maximum(with_[0] + with_[1], 1)
        log_ratio = sum(x * np.log(np.maximum(x, 1) / (share * n)) for x, share in ((with_[1], q), (with_[0], 1 - q)))
        sure = np.where(odds > STRONG, log_ratio, -np.inf)  # by chance alone, fewer than SURE values of all would keep to toxic documents so
        evidence = np.where(enough, np.maximum(evidence, sure[of]), evidence)
        tried = max(tried, int((with_[0] + with_[1] > 0).sum()))
    return back_to.astype(np.int32), evidence, tried


def train(texts: list[str], toxic: np.ndarray, prevalence: float) -> Field:
    parts, counts, opens, n = [], [], [], 0
    for group in grouped(texts):
        found, _, _, of, new = tokenize(group)
        parts.append(found.astype(np.int32))
        counts.append(np.diff(of))
        opens.append(new + n)
        n += len(found)
    features, begins = np.concatenate(parts), np.concatenate(opens)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    del parts, opens
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    size = 1 << BITS
    n0, n1 = (toxic == 0).sum(), (toxic == 1).sum()
    y = np.zeros(len(doc), bool)
    found = [_telling(doc, features[:, k], toxic, size) for k in range(features.shape[1])]
    tried = sum(n for *_, n in found)
    for back_to, evidence, _ in found:
        y |= (evidence > np.log(max(1, tried) / SURE))[back_to] & (toxic[doc] == 1)
    del found

    used, compact = np.unique(features, return_inverse=True)
    compact = compact.reshape(features.shape).astype(np.int32)
    w, b, move = np.zeros(len(used)), np.array([-3.0]), np.zeros((2, 2))
    opt = Adam([w, b, move], 0.3)
    opens = np.zeros(len(y), bool)
    opens[begins] = True
    after = np.flatnonzero(~opens)  # tokens with one before them
    for _ in range(EPOCHS):
        u = w[compact].sum(axis=1) + b[0]
        p, forth, back = marginals(u, move, begins)
        d = p - y
        t, e = np.exp(move), np.exp(np.clip(u, -30, 30))
        gm = np.zeros((2, 2))
        if len(after):
            r, s = forth[after - 1], e[after] * back[after]
            pair = np.stack([t[0, 0] + 0 * r, t[0, 1] * s, t[1, 0] * r, t[1, 1] * r * s])
            pair /= pair.sum(axis=0)
            gm = pair.sum(axis=1).reshape(2, 2) - np.bincount(2 * y[after - 1].astype(int) + y[after].astype(int), minlength=4).reshape(2, 2)
        n = max(1, y.sum())
        opt.step([np.bincount(compact.ravel(), np.repeat(d, 4), len(used)) / n + 1e-5 * w, np.array([d.sum() / n]), gm / n + 1e-4 * move])
    weights = np.zeros(size, np.float64)
    weights[used] = w
    field = Field(weights, float(b[0]), move, np.zeros(4))
    x = summary(field.tokens(features, begins), first)
    share = np.where(toxic == 1, prevalence / max(n1, 1), (1 - prevalence) / max(n0, 1)) * len(toxic)
    field.score = fit_logistic(x, toxic, share, 0.1)
    return field


def _score(batches: Iterator[pa.RecordBatch], field: Field, with_spans: bool) -> Iterator[pa.RecordBatch]:
    for part, texts in blocks(batches):
        features, starts, ends, first, begins = tokenize(texts)
        p = field.tokens(features, begins)
        score = logistic(summary(p, first) @ field.score[:-1] + field.score[-1])
        out = [part.column(0), pa.array(score)]
        names = ["doc_id", "score"]
        if with_spans:
            at = codes(texts)[1]
            hits = np.flatnonzero(p > 0.5)
            doc = np.searchsorted(first, hits, "right") - 1
            runs = pa.StructArray.from_arrays([pa.array(starts[hits] - at[doc], pa.int32()), pa.array(ends[hits] - at[doc], pa.int32()), pa.array(p[hits], pa.float64())], names=["start", "stop", "p"])
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32()), runs))
            names.append("spans")
        yield pa.RecordBatch.from_arrays(out, names=names)


def fit(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> Field:
    """Learn from labels(doc_id, toxic); the caller leaves out what must not be learned from."""
    labels = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))  # each document once
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = [sample(docs, labels.filter(F.col("toxic") == k), ["toxic"], n) for k in (0, 1)]
    return fitted(rows[0].unionByName(rows[1]), lambda found: _fit(found, share))


def _fit(found: pd.DataFrame, prevalence: float) -> Field:
    parts = [found["text"][found["toxic"] == k].tolist() for k in (0, 1)]
    parts = [[t for t, new in zip(texts, novel(texts), strict=True) if new] for texts in parts]
    if not parts[0] or not parts[1]:
        base = np.zeros(4)
        base[-1] = np.log((prevalence + 1e-9) / (1 - prevalence + 1e-9))
        return Field(np.zeros(1 << BITS), -30.0, np.zeros((2, 2)), base)
    return train(parts[0] + parts[1], np.array([0] * len(parts[0]) + [1] * len(parts[1])), prevalence)


def scores(docs: DataFrame, field: Field, with_spans: bool = False) -> DataFrame:
    """doc_id, score and, if asked, spans (start, stop in code points, p) of the tokens likelier toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 2 MB, whatever the input
    kind = "doc_id bigint, score double" + ", spans array<struct<start:int,stop:int,p:double>>" * with_spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda x: _score(x, shared.value, with_spans), kind)


def _clean(batches: Iterator[pa.RecordBatch], field: Field, text: int) -> Iterator[pa.RecordBatch]:
    release()
    for part, texts in blocks(batches, text):
        features, _, _, first, begins = tokenize(texts)
        score = logistic(summary(field.tokens(features, begins), first) @ field.score[:-1] + field.score[-1])
        yield part.filter(pa.array(score < TOXIC))


def clean(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs whose score is below TOXIC, as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index("text")
    return docs.mapInArrow(lambda x: _clean(x, shared.value, at), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(3, 1))
    found = scores(docs, fit(docs, labels), with_spans=True)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "spans")

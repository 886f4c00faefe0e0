"""Document quality by positive-unlabelled learning.

A small network over features of a text's surface, and weights of its hashed words and letter trigrams, are fitted by the
non-negative unbiased risk: with class prior p, p R+(positive) + max(0, R-(unlabelled) - p R-(positive)), with the logistic loss.
Positives are documents labelled good; the unlabelled ones are drawn from all documents; labels of the other kind are not used.

The class prior is estimated from positives and unlabelled texts alone: a network that tells the two apart is fitted on one half
of each, and on the other half the prior is the smallest ratio of unlabelled to positive texts above a score, where that ratio
plus its confidence bound is least: at the top, unlabelled texts are good ones. The halves change places and the mean counts.

All is fitted, in one task of an executor, on at most SAMPLE positives and twice as many unlabelled texts, those with the smallest
hashes of their doc_id and at most LONGEST code points, CHARS in all; near copies among the positives are left out.

Cases: a null or empty text has the features of no characters and is scored like any other; repeated rows are scored each;
null or repeated labels count not at all or once; with fewer than two positives every score is PRIOR; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.learn import Adam, char_hash, fitted, grouped, held_out, letters, logistic, lower, novel, sample
from assaylake.llm.textvec import blocks, codes, is_space, mix, run_hashes, spans

SAMPLE, HIDDEN, STEPS, BATCH, PRIOR = 2500, 24, 1000, 256, 0.5
#: Code points of the texts it is fitted on, all together, and buckets of hashed words and of trigrams.
CHARS, BUCKETS = 12_000_000, 256
GOOD = 0.7
MARKS = np.array([ord(c) for c in ".,;:?'\"-()"], np.uint32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: shares of kinds of characters, of words and lines that repeat, and sizes; and roots of the shares of hashed words and trigrams."""
    raw, at = codes(texts)
    space, letter = is_space(raw), letters()[raw]
    upper = letter & (lower()[raw] != raw)
    digit = (raw >= 48) & (raw <= 57)
    mark = np.isin(raw, MARKS)
    other = ~(space | letter | digit | mark)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    n = np.maximum(np.diff(at) - 1, 1)
    starts, ends = spans(~space)
    first = np.searchsorted(starts, at)
    words = run_hashes(lower()[raw], starts, ends)
    n_words = np.diff(first)
    m = np.maximum(n_words, 1)
    opens = np.concatenate([[0], np.cumsum(upper[starts])])
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    squares = np.concatenate([[0], np.cumsum((ends - starts).astype(np.float64) ** 2)])
    bare = np.concatenate([[0], np.cumsum(~letter[starts])])
    tails = np.concatenate([[0], np.cumsum(other[ends - 1] if len(ends) else np.zeros(0))])
    per = lambda x: x[first[1:]] - x[first[:-1]]
    doc = np.repeat(np.arange(len(texts)), n_words)

    def distinct(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, d))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])
        return np.bincount(d[order][new], minlength=len(texts))

    twice = np.zeros(len(words), bool)
    twice[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    pairs = words[:-1] * np.uint64(3) + words[1:] if len(words) > 1 else words[:0]
    same_doc = doc[1:] == doc[:-1] if len(words) > 1 else np.zeros(0, bool)
    ls, le = spans(raw != 10)
    line_doc = np.searchsorted(at, ls, "right") - 1
    lines = np.bincount(line_doc, minlength=len(texts))
    mean = per(lengths) / m
    surface = np.column_stack([
        np.log1p(n), np.log1p(n_words), total(letter) / n, total(upper) / n, total(digit) / n, total(mark) / n, total(other) / n, total(space) / n,
        mean, np.sqrt(np.maximum(per(squares) / m - mean**2, 0)), per(opens) / m, per(bare) / m, per(tails) / m,
        distinct(words, doc) / m, np.bincount(doc, twice, len(texts)) / m, distinct(pairs[same_doc], doc[1:][same_doc]) / np.maximum(n_words - 1, 1),
        distinct(run_hashes(raw, ls, le), line_doc) / np.maximum(lines, 1), np.log1p(lines), np.log1p(n_words / np.maximum(lines, 1)),
    ])

    def hashed(h: np.ndarray, d: np.ndarray, of: np.ndarray) -> np.ndarray:
        at = d * BUCKETS + (mix(h) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        return np.sqrt(np.bincount(at, minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS) / np.maximum(of, 1)[:, None]).astype(np.float32)

    h = char_hash()[lower()[raw]]
    grams = h * np.uint64(3) + np.roll(h, -1) * np.uint64(0x9E3779B97F4A7C15) + np.roll(h, -2) * np.uint64(0xC2B2AE3D27D4EB4F)
    return surface, np.hstack([hashed(words, doc, n_words), hashed(grams, np.repeat(np.arange(len(texts)), np.diff(at)), np.diff(at))])


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [features(g) for g in grouped(texts)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # to the hidden layer, its offsets, from it, offset, of the hashed features
    prior: float = PRIOR

    def squeezed(self, surface: np.ndarray) -> np.ndarray:
        return np.clip((surface - self.mean) / self.scale, -8, 8)

    def margin(self, x: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        a, b, c, d, e = self.weights
        return np.tanh(x @ a + b) @ c + d[0] + hashed @ e

    def score(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return logistic(self.margin(self.squeezed(found[0]), found[1]))


Features = tuple[np.ndarray, np.ndarray]


def train(good: Features, every: Features, prior: float | None, steps: int = STEPS, seed: int = 3) -> Network:
    """Minimise the non-negative risk by Adam; where the risk of negatives falls below zero, its gradient is turned round.

    Without a prior, all unlabelled texts count as negatives: the network then ranks texts by how much likelier they are good ones.
    """
    rng = np.random.default_rng(seed)
    k = good[0].shape[1]
    weights = [rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1), np.zeros(good[1].shape[1], np.float32)]
    net, opt = Network(every[0].mean(axis=0), every[0].std(axis=0) + 1e-6, weights), Adam(weights, 0.01)
    (good, good_hashed), (every, every_hashed) = ((net.squeezed(x), h) for x, h in (good, every))
    for step in range(steps):
        opt.rate = 0.01 * (1 - step / steps) + 0.0003
        i, j = rng.integers(0, len(good), BATCH), rng.integers(0, len(every), 2 * BATCH)
        drawn = [(good[i], good_hashed[i]), (every[j], every_hashed[j])]
        gp, gu = (net.margin(x, h) for x, h in drawn)
        if prior is None:
            dp, du = (logistic(gp) - 1) / len(gp), logistic(gu) / len(gu)
        elif np.logaddexp(0, gu).mean() > prior * np.logaddexp(0, gp).mean():
            dp, du = np.full(len(gp), -prior / len(gp)), logistic(gu) / len(gu)  # of p R+ - p R-, which the logistic loss makes linear
        else:
            dp, du = prior * logistic(gp) / len(gp), -logistic(gu) / len(gu)
        grads = [1e-4 * w for w in weights]
        grads[4] = 1e-3 * weights[4]
        for (x, hashed), d in zip(drawn, (dp, du), strict=True):
            hidden = np.tanh(x @ weights[0] + weights[1])
            inner = d[:, None] * weights[2] * (1 - hidden * hidden)
            for g, more in zip(grads, (x.T @ inner, inner.sum(axis=0), hidden.T @ d, np.array([d.sum()]), d.astype(np.float32) @ hashed), strict=True):
                g += more
        opt.step(grads)
    return net


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from scores of held-out texts: the ratio of shares above a score, where it is surest to be small."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    above = [1 - np.searchsorted(np.sort(x), cuts, "left") / len(x) for x in (positive, unlabelled)]
    width = sum(0.5 / np.sqrt(len(x)) for x in (positive, unlabelled))  # the greatest standard error of a share
    p, u = (x[above[0] > 0] for x in above)
    best = np.argmin((u + width) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def _part(x: Features, odd: int) -> Features:
    return x[0][odd::2], x[1][odd::2]


def _fit(found: pd.DataFrame) -> Network | float:
    good, every = (found["text"][found["good"] == k].tolist() for k in (1, 0))
    good = [t for t, new in zip(good, novel(good), strict=True) if new]
    if len(good) < 2 or len(every) < 2:
        return PRIOR
    good, every = features_of(good), features_of(every)
    guesses = []
    for odd in (0, 1):
        ranks = train(_part(good, odd), _part(every, odd), None, STEPS // 4)
        guesses.append(prior_of(*(ranks.score(_part(x, 1 - odd)) for x in (good, every))))
    net = train(good, every, float(np.mean(guesses)))
    net.prior = float(np.mean(guesses))
    return net


def _score(batches: Iterator[pa.RecordBatch], net: Network | float) -> Iterator[pa.RecordBatch]:
    for part, texts in blocks(batches):
        score = np.full(len(texts), net) if isinstance(net, float) else net.score(features(texts))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(np.float64))], names=["doc_id", "score"])


def fit(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> Network | float:
    """Learn from labels(doc_id, quality) and docs(doc_id, text); the caller leaves out labels that must not be learned from."""
    good = sample(docs, labels.filter("doc_id IS NOT NULL AND quality = 1").select("doc_id", F.lit(1).alias("good")), ["good"], n)
    every = sample(docs, docs.filter("doc_id IS NOT NULL").select("doc_id", F.lit(0).alias("good")), ["good"], 2 * n)
    return fitted(good.unionByName(every), _fit, CHARS)


def scores(docs: DataFrame, net: Network | float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few kB
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda x: _score(x, shared.value), "doc_id bigint, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(4, 2))
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))

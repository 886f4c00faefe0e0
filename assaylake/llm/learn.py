"""Bounded samples of labelled rows, character tables and small optimizers for the models trained here."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.textvec import mix, release, shingle_sets


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def held_out(parts: int, which: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), parts) == which, F.lit(False))


#: Code points of a sample that a model is fitted on: of one text, and of all.
LONGEST, CHARS = 100_000, 6_000_000


def sample(docs: DataFrame, rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """doc_id, text, *columns of the n rows(doc_id, *columns) with the smallest hashes of their doc_id; never more than n rows.

    Rows with an equal doc_id count once (the smallest); docs that repeat a doc_id give one text, the first in order.
    Texts of more than LONGEST code points are left out of the sample, not of what is scored.
    """
    ids = rows.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in columns)).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(n)
    return texts_of(docs, ids, columns)


def texts_of(docs: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """The text of each of ids(doc_id, *columns), a bounded number of rows."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= LONGEST).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", *columns).agg(F.min("text").alias("text"))


def fitted(frame: DataFrame, train: Callable[[pd.DataFrame], object], chars: int = CHARS) -> object:
    """train(rows of the bounded sample) in one task of an executor; only the model comes to the driver.

    Rows come in order of the hash of their doc_id, those without one first, up to `chars` code points in all. A lost executor costs a retry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kept, held = [], 0
        for batch in batches:
            upto = np.cumsum([len(t) for t in batch.column("text").to_pylist()]) + held
            kept.append(batch.slice(0, int((upto <= chars).sum())).to_pandas())
            if len(upto) and upto[-1] > chars:
                break
            held = int(upto[-1]) if len(upto) else held
        rows = pd.concat(kept, ignore_index=True) if kept else pd.DataFrame(columns=frame_columns)
        model = pickle.dumps(train(rows))
        del kept, rows
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    frame_columns = frame.columns
    frame = frame.repartition(1).sortWithinPartitions(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(1)), "doc_id", "text")
    found = frame.mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else train(pd.DataFrame(columns=frame.columns))


def grouped(texts: list[str], chars: int = 400_000) -> Iterator[list[str]]:
    """Texts in groups of about so many characters, so that arrays over characters stay small."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > chars:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def novel(texts: list[str], share: float = 0.5) -> np.ndarray:
    """Which texts of a sample share less than so much of their 4-word shingles with those before: copies would count as evidence again and again."""
    sets = [s for group in grouped(texts) for s in shingle_sets(group, 4)]
    if not sets:
        return np.zeros(0, bool)
    n = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), n)
    every = np.concatenate(sets)
    del sets
    order = np.argsort(every, kind="stable")  # of equal shingles, that of the first text comes first
    known = np.zeros(len(every), bool)
    known[order[1:]] = every[order[1:]] == every[order[:-1]]
    return np.bincount(doc[known], minlength=len(n)) < share * np.maximum(n, 1)


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def lower() -> np.ndarray:
    """The lower-case code point, where that is a single one."""
    small = (chr(c).lower() for c in range(0x110000))
    return np.fromiter((ord(s) if len(s) == 1 else c for c, s in enumerate(small)), np.uint32, 0x110000)


@cache
def char_hash() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x1234567))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the last one the intercept, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

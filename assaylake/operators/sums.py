"""Aggregates of whole vectors, a row a task instead of a row an element.

Each task folds its rows into one block of numbers for each group, by Arrow batches, and hands it on in chunks of positions; a grouped
aggregate over chunks merges what the tasks found. What a task holds is bounded by HELD, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from assaylake.session import written

#: Positions of a chunk, and bytes that a task holds before it hands on what it has.
CHUNK, HELD = 4096, 64 << 20


class Moments:
    """Of each position: n, mean, sum of squared deviations, least, greatest, and the values that are null or not finite."""

    ROWS = 6

    @staticmethod
    def of(x: np.ndarray) -> np.ndarray:
        ok = np.isfinite(x)
        n = ok.sum(axis=0)
        kept = np.where(ok, x, 0.0)
        mean = kept.sum(axis=0) / np.maximum(n, 1)
        off = np.where(ok, x - mean, 0.0)
        return np.stack([n, mean, (off * off).sum(axis=0), np.where(ok, x, np.inf).min(axis=0), np.where(ok, x, -np.inf).max(axis=0), len(x) - n])

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        share, d = b[0] / np.maximum(n, 1), b[1] - a[1]
        return np.stack([n, a[1] + d * share, a[2] + b[2] + d * d * a[0] * share, np.minimum(a[3], b[3]), np.maximum(a[4], b[4]), a[5] + b[5]])


class Sums:
    """Sums, a row for each block that is folded in."""

    ROWS = 1

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b


def blocks(batch: pa.RecordBatch, keys: int, values: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Of a batch whose first columns are keys: each key, which rows have it, and their vectors as a matrix; those of a key have one length."""
    column = batch.column(values)
    if column.null_count:
        raise ValueError("a vector is missing")
    offsets = column.offsets.to_numpy()
    lengths, x = np.diff(offsets), column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    alike = not len(lengths) or (lengths == lengths[0]).all()
    if alike:
        x = x.reshape(len(lengths), -1)
    groups = [((), np.arange(len(lengths)))] if not keys else _keyed(batch, keys)
    for key, rows in groups:
        if alike:
            yield key, rows, x[rows]
            continue
        n = lengths[rows[0]]
        if (lengths[rows] != n).any():
            raise ValueError("vectors must be of one length")
        yield key, rows, x[(offsets[rows] - offsets[0])[:, None] + np.arange(n)]


def _keyed(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    names = pd.MultiIndex.from_arrays([pd.Index(batch.column(k).to_pylist(), dtype=object) for k in range(keys)])
    codes, found = names.factorize()
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(found) + 1))
    for k, key in enumerate(found):
        yield tuple(None if v is pd.NA or v != v else v for v in key), order[ends[k] : ends[k + 1]]


def folded(df: DataFrame, group: list[str], fold: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[tuple, np.ndarray]]], kind: type = Sums, keys: list[StructField] | None = None) -> DataFrame:
    """For each group: `sums`, the merged block of all (key, block) that `fold` yields for the batches of a task, row after row.

    A group's blocks must have one shape. The groups are named by columns of df, or by what `keys` says.
    """
    keys = keys or [df.schema[c] for c in group]
    schema = StructType([*keys, StructField("chunk", LongType()), StructField("width", LongType()), StructField("sums", ArrayType(DoubleType()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        size = 0
        for key, block in fold(batches):
            if key in held:
                held[key] = kind.merge(held[key], block)
            else:
                held[key] = block
                size += block.nbytes
            if size > HELD:
                yield from chunked(held)
                held, size = {}, 0
        yield from chunked(held)

    def chunked(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(schema)
        for key, block in held.items():
            block = block.reshape(kind.ROWS, -1)
            parts = [block[:, lo : lo + CHUNK] for lo in range(0, block.shape[1], CHUNK)]
            columns = [pa.array([k] * len(parts), f.type) for k, f in zip(key, own, strict=False)]
            rest = [pa.array(range(len(parts)), pa.int64()), pa.array([p.shape[1] for p in parts], pa.int64()), pa.array([p.ravel() for p in parts], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, *rest], schema=own)

    @F.pandas_udf("array<double>")
    def merged(sums: pd.Series) -> list:
        out = None
        for x in sums:
            x = np.asarray(x, float).reshape(kind.ROWS, -1)
            out = x if out is None else kind.merge(out, x)
        return out.ravel().tolist()

    each = df.mapInArrow(partial, schema).groupBy(*group, "chunk", "width").agg(merged("sums").alias("sums"))
    rows = each.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("chunk", "width", "sums"))).alias("parts"))  # as long as a block
    row = lambda k: F.flatten(F.transform("parts", lambda p: F.slice(p["sums"], F.lit(k) * p["width"] + 1, p["width"])))
    return rows.select(*group, F.flatten(F.array(*map(row, range(kind.ROWS)))).alias("sums"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what is read more than once is found once."""
    return written(df.sparkSession, df, name)


def moments(df: DataFrame, group: list[str], values: str = "values") -> DataFrame:
    """For each group, arrays by position: n, mean, sd (of the population), low, high and n_not_finite; null and not finite values count in the last alone."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                for key, _, x in blocks(batch, len(group), len(group)):
                    yield key, Moments.of(x)

    found = folded(df.select(*group, values), group, fold, Moments)
    width = (F.size("sums") / Moments.ROWS).cast("int")
    part = lambda k: F.slice("sums", F.lit(k) * width + 1, width)
    n, m2 = part(0), part(2)
    there = lambda k: F.zip_with(n, part(k), lambda c, x: F.when(c > 0, x))
    whole = lambda c: F.transform(c, lambda x: x.cast("bigint"))
    sd = F.zip_with(n, m2, lambda c, s: F.when(c > 0, F.sqrt(s / c)))
    return found.select(*group, whole(n).alias("n"), there(1).alias("mean"), sd.alias("sd"), there(3).alias("low"), there(4).alias("high"), whole(part(5)).alias("n_not_finite"))

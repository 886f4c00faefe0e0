"""Hard negatives by a vector-approximation file.

Vectors are integers. Each dimension is cut into CELLS cells, at quantiles of a bounded sample between the smallest and the largest value
of all rows, so that every value lies in the cell that its code, a byte, names. The file holds the codes beside the vectors. For an
anchor q and a row, each dimension's cell has edges a <= x <= b; looked up by its code, they bound the score from below by the sum of q a
where q > 0 and q b where q < 0, and from above the other way round. No row is scored unless these bounds let it enter:

1. Positives: an anchor's `near` best of its own label. A row enters if its upper bound reaches the least score kept so far and
   the `near`-th largest lower bound of those that stand with it.
2. Negatives: for each positive, the `near` best of other labels in the window of scores the positive opens. A row enters if its bounds
   meet the window and its upper bound reaches the least score kept in it.

Anchors are dealt into blocks of about BLOCK, a broadcast of bounded size for each; a task meets a block with the rows it reads
itself, so rows are never shuffled, and hands on `near` rows for each anchor or window at most. What is kept ties by the smaller
vec_id. Bounds are sums of whole numbers that floats hold exactly; so the result is that of scoring every row.

Cases: rows without a vec_id, a label or a vector, or with a component that is null, not finite or 2^18 or more in size (scores are
longs) take no part; a shorter vector counts as if zeros followed; an anchor without another row of its label has no positives, a
positive with an empty window no negatives; rows that repeat a vec_id count each by itself, and each is an anchor if one is; an empty
table gives an empty result; columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assaylake.llm.common import written
from assaylake.llm.textvec import release

#: Cells of a dimension, rows that their quantiles are taken from, anchors of a block, and anchors and rows that are bounded together.
CELLS, SAMPLE, BLOCK, TILE, ROWS = 64, 4096, 20_000, 256, 4096
#: Rows scored together.
PAIRS = 50_000
LEAST = -(1 << 62)
FILE = "row bigint, vec_id bigint, label bigint, anchor boolean, vector array<int>, codes binary"


@dataclass
class Cells:
    """Edges of the cells: dimension d's cell c holds the whole numbers from low[d, c] to high[d, c]."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int = CELLS) -> Cells:
        cuts = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="nearest").T.astype(np.int64) if len(sample) else np.zeros((len(least), cells - 1), np.int64)
        cuts = np.clip(cuts, least[:, None], most[:, None] + 1)
        return cls(np.column_stack([least, cuts]), np.column_stack([cuts - 1, most]))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, x, "right") for cuts, x in zip(self.low[:, 1:], vectors.T, strict=True)], axis=1).astype(np.uint8) if vectors.size else np.zeros(vectors.shape, np.uint8)


@dataclass
class Block:
    """Anchors in order of their labels, the edges of the cells, and for windows the scores from and to which each reaches."""

    row: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    cells: Cells
    near: int
    score: np.ndarray | None = None  # of the positive that opens a window, anchors x windows
    lowest: np.ndarray | None = None  # lowest > highest where there is none
    highest: np.ndarray | None = None

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Positive and negative parts of the anchors, in a kind that holds all bounds exactly."""
        size = np.abs(np.concatenate([self.cells.low, self.cells.high], axis=1)).max(initial=0) * np.abs(self.vector).max(initial=0) * max(1, self.vector.shape[1])
        kind = np.float32 if size < 1 << 24 else np.float64
        return np.maximum(self.vector, 0).astype(kind), np.minimum(self.vector, 0).astype(kind)


class Best:
    """The `near` best rows of each of n lists, by score, then vec_id, then row."""

    def __init__(self, n: int, near: int):
        self.near = near
        self.score, self.vec_id, self.row = np.full((n, near), LEAST), np.zeros((n, near), np.int64), np.zeros((n, near), np.int64)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        lists = np.unique(of)
        if not len(lists):
            return
        held = (np.repeat(np.arange(len(lists)), self.near), self.score[lists].ravel(), self.vec_id[lists].ravel(), self.row[lists].ravel())
        of, score, vec_id, row = (np.concatenate(x) for x in zip((np.searchsorted(lists, of), score, vec_id, row), held, strict=True))
        order = np.lexsort((row, vec_id, -score, of))
        of = of[order]
        first = order[np.arange(len(of)) - np.searchsorted(of, of) < self.near]  # a list has `near` entries at least
        self.score[lists], self.vec_id[lists], self.row[lists] = (x[first].reshape(-1, self.near) for x in (score, vec_id, row))


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, vec_id, label, vectors and codes of ROWS rows of the file at a time."""
    for lo in range(0, batch.num_rows, ROWS):
        part = batch.slice(lo, ROWS)
        row, vec_id, label = (part.column(k).to_numpy() for k in range(3))
        vector = part.column(4).flatten().to_numpy().reshape(-1, width).astype(np.int64)
        yield row, vec_id, label, vector, np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(-1, width)


def _bounds(parts: tuple[np.ndarray, np.ndarray], edges: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that the cells allow, anchors x rows."""
    (over, under), (low, high) = parts, edges
    return over @ low.T + under @ high.T, over @ high.T + under @ low.T


def _edges(cells: Cells, codes: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(codes.shape[1])
    return cells.low[at, codes].astype(kind), cells.high[at, codes].astype(kind)


def _scores(anchors: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [np.einsum("nd,nd->n", anchors[i[k : k + PAIRS]], vectors[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _nth_largest(x: np.ndarray, n: int) -> np.ndarray:
    return np.partition(x, -n, axis=1)[:, -n] if x.shape[1] >= n else np.full(len(x), -np.inf, x.dtype)


def _positives(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """anchor row, positive row, vec_id and score: the best of each anchor's label among a task's rows."""
    release()
    best, parts, width = Best(len(block.row), block.near), block.parts(), block.vector.shape[1]
    labels, begins = np.unique(block.label, return_index=True)
    stops = [*begins.tolist(), len(block.label)][1:]
    for batch in batches:
        for row, vec_id, label, vector, codes in _rows(batch, width):
            for own, begin, stop in zip(labels.tolist(), begins.tolist(), stops, strict=True):
                mine = np.flatnonzero(label == own)
                if not len(mine):
                    continue
                edges = _edges(block.cells, codes[mine], parts[0].dtype)
                for lo in range(begin, stop, TILE):
                    tile = slice(lo, min(lo + TILE, stop))
                    least, most = _bounds((parts[0][tile], parts[1][tile]), edges)
                    itself = block.row[tile][:, None] == row[mine][None]
                    least[itself] = most[itself] = -np.inf
                    enough = np.maximum(best.least()[tile], _nth_largest(least, block.near))
                    i, j = np.nonzero((most >= enough[:, None]) & ~itself)
                    best.add(i + lo, _scores(block.vector[tile], vector, i, mine[j]), vec_id[mine[j]], row[mine[j]])
    i, k = np.nonzero(best.score > LEAST)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.row[i], best.row[i, k], best.vec_id[i, k], best.score[i, k])], names=["anchor", "positive", "positive_id", "positive_score"])


def _negatives(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """anchor row, score of the positive, vec_id, row and score: the best of other labels in each window among a task's rows."""
    release()
    n, windows = block.highest.shape
    best, parts, width = Best(n * windows, block.near), block.parts(), block.vector.shape[1]
    open_ = block.lowest <= block.highest
    for batch in batches:
        for row, vec_id, label, vector, codes in _rows(batch, width):
            edges = _edges(block.cells, codes, parts[0].dtype)
            for lo in range(0, n, TILE):
                tile = slice(lo, min(lo + TILE, n))
                least, most = _bounds((parts[0][tile], parts[1][tile]), edges)
                other = block.label[tile][:, None] != label[None]
                for w in np.flatnonzero(open_[tile].any(axis=0)).tolist():
                    lowest, highest = (np.where(open_[tile, w], x[tile, w], y)[:, None] for x, y in ((block.lowest, 1), (block.highest, 0)))
                    enough = np.maximum(lowest, best.least().reshape(n, windows)[tile, w][:, None])
                    may = other & (most >= enough) & (least <= highest) & open_[tile, w][:, None]
                    if may.sum() > 8 * block.near * len(may):  # then the rows that are in the window for sure tell what is enough
                        sure = np.where(may & (least >= lowest) & (most <= highest), least, -np.inf)
                        may &= most >= _nth_largest(sure, block.near)[:, None]
                    i, j = np.nonzero(may)
                    score = _scores(block.vector[tile], vector, i, j)
                    inside = (score >= lowest[i, 0]) & (score <= highest[i, 0])
                    i, j, score = i[inside], j[inside], score[inside]
                    best.add((i + lo) * windows + w, score, vec_id[j], row[j])
    i, k = np.nonzero(best.score > LEAST)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.row[i // windows], block.score.ravel()[i], best.vec_id[i, k], best.row[i, k], best.score[i, k])], names=["anchor", "positive_score", "negative_id", "negative", "negative_score"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest and the largest value of each dimension in a task."""
    least, most = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        column = batch.column(0)
        counts, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
        for n in np.unique(counts).tolist():  # vectors of one length together: mostly all
            x = values[np.repeat(counts == n, counts)].reshape(-1, n) if n else np.zeros((1, 0), np.int64)
            if n > len(least):
                least, most = (np.concatenate([y, np.full(n - len(y), z)]) for y, z in ((least, 1 << 40), (most, -(1 << 40))))
            least[:n], most[:n] = np.minimum(least[:n], x.min(axis=0)), np.maximum(most[:n], x.max(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(least))), pa.array(least), pa.array(most)], names=["at", "least", "most"])


def _coded(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    width = len(cells.low)
    for batch in batches:
        vectors = np.zeros((batch.num_rows, width), np.int32)
        column = batch.column(batch.schema.get_field_index("vector"))
        counts = np.diff(column.offsets.to_numpy())
        vectors[np.arange(width)[None] < counts[:, None]] = column.flatten().to_numpy()
        codes = cells.codes(vectors)
        full = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(vectors.ravel()))
        packed = pa.array([x.tobytes() for x in codes], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], full, packed], names=["row", "vec_id", "label", "anchor", "vector", "codes"])


def index(spark: SparkSession, rows: DataFrame, anchors: Column, scale: int = 256) -> tuple[DataFrame, Cells]:
    """The vector-approximation file of rows(vec_id, embedding, label), a written table, and its cells; x counts as floor(scale * x)."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= 1 << 18), F.lit(True))), F.lit(True))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vector")
    kept = rows.filter(usable).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), vector)
    kept = written(spark, kept, "vectors")
    ranges = kept.select("vector").mapInArrow(_ranges, "at bigint, least bigint, most bigint").groupBy("at").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("at").collect()  # a row for each dimension
    ranges = ranges or [{"least": 0, "most": 0}]
    short = kept.agg(F.min(F.size("vector"))).first()[0]
    least, most = (np.array([r[c] for r in ranges], np.int64) for c in ("least", "most"))
    if short is not None:  # zeros follow shorter vectors
        least[short:], most[short:] = np.minimum(least[short:], 0), np.maximum(most[short:], 0)
    drawn = kept.select("vec_id", "row", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).collect()
    sample = np.zeros((len(drawn), len(least)), np.int64)
    for k, r in enumerate(drawn):
        sample[k, : len(r["vector"])] = r["vector"]
    cells = Cells.of(sample, least, most)
    return written(spark, kept.mapInArrow(lambda x: _coded(x, cells), FILE), "vector-file"), cells


def _best(found: DataFrame, of: list[str], score: str, ids: tuple[str, str], near: int) -> DataFrame:
    """The best rows of each list over all tasks, with their rank: of each task and list there are `near` rows at most."""
    order = W.partitionBy(*of).orderBy(F.col(score).desc(), *ids)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= near)


def mine(spark: SparkSession, rows: DataFrame, anchors: Column, near: int = 5, low: int = 80, high: int = 100, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among rows(vec_id, embedding, label).

    Negatives score from low to high percent of the positive. Each block of anchors adds a table; results are read lazily.
    """
    file, cells = index(spark, rows, anchors)
    names = file.filter("anchor").select("row", "vec_id")
    blocks = max(1, -(-names.count() // block))
    kinds = "anchor bigint, positive bigint, positive_id bigint, positive_score bigint", "anchor bigint, positive_score bigint, negative_id bigint, negative bigint, negative_score bigint"
    out = None
    for k in range(blocks):
        asked = file.filter(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)).select("row", "label", "vector").toArrow()  # about `block` rows
        row, label = (asked.column(c).to_numpy() for c in ("row", "label"))
        vector = np.stack(asked.column("vector").to_numpy()).astype(np.int64) if len(row) else np.zeros((0, len(cells.low)), np.int64)
        order = np.lexsort((row, label))
        own = Block(row[order], label[order], vector[order], cells, near)
        shared = spark.sparkContext.broadcast(own)
        found = file.mapInArrow(lambda x, shared=shared: _positives(x, shared.value), kinds[0])
        positives = written(spark, _best(found, ["anchor"], "positive_score", ("positive_id", "positive"), near).drop("rank"), "positives")
        shared.unpersist()

        reached = positives.select("anchor", "positive_score").distinct().toArrow()  # `near` rows for each anchor of the block at most
        at, score = (reached.column(c).to_numpy() for c in ("anchor", "positive_score"))
        by_row = np.argsort(own.row)
        at = by_row[np.searchsorted(own.row, at, sorter=by_row)]
        ordered = np.lexsort((-score, at))
        at, score = at[ordered], score[ordered]
        own.score, own.lowest, own.highest = (np.full((len(own.row), near), x) for x in (0, 1, 0))
        slot = np.arange(len(at)) - np.searchsorted(at, at)
        own.score[at, slot], own.lowest[at, slot], own.highest[at, slot] = score, -(-low * score // 100), high * score // 100
        shared = spark.sparkContext.broadcast(own)
        found = file.mapInArrow(lambda x, shared=shared: _negatives(x, shared.value), kinds[1])
        negatives = _best(found, ["anchor", "positive_score"], "negative_score", ("negative_id", "negative"), near).drop("negative")
        made = written(spark, positives.join(negatives, ["anchor", "positive_score"]), "negatives")
        shared.unpersist()
        out = made if out is None else out.unionByName(made)
    out = out.join(names.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(spark, rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE label = own AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5
"""

"""Byte-level BPE by a vocabulary of ranks: texts to ids, and ids back to bytes.

A text is cut into pre-tokens, the matches of a pattern. Each is looked up in two tiers:

1. A minimal perfect hash over the vocabulary names one slot for a pre-token, and its bytes are compared with the one entry that
   the slot holds. All distinct pre-tokens of some hundred thousand characters are looked up at once, in arrays.
2. The others, if not remembered, are merged from single bytes: a heap holds the pairs of neighbours by rank, then by place, over
   a linked list of what the bytes have become. A run of n bytes takes n log n steps, however long it is.

The hash is built by displacement: keys fall into buckets, the fullest first gets the first displacement that sends all its keys
to free slots, and the keys that are alone in theirs are given the slots that are left. There are as many slots as keys.

Cases: a null or empty text has no ids and decodes to no bytes; rows that repeat a doc_id get a row each; a null doc_id stays null;
an empty table gives an empty result; columns other than doc_id and text are not read; strings of special tokens are plain text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.textvec import blocks, mix, release, remembers, run_hashes
from assaylake.llm.tokens import Recent

#: Keys for each bucket, on average; displacements that are tried together; pre-tokens, short ones, in each of two generations that a worker remembers.
PER_BUCKET, TRIES, KEPT = 1.5, 64, 300_000
#: Ids that are decoded together; a longer document is taken alone.
GROUP = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """A slot in [0, n) for each of n distinct 64-bit hashes; any slot for others."""

    def __init__(self, hashes: np.ndarray):
        n = self.n = len(hashes)
        self.buckets = max(1, int(n / PER_BUCKET))
        self.places = np.zeros(self.buckets, np.int64)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        begins = np.cumsum(sizes) - sizes
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            keys = hashes[order[begins[b] : begins[b] + sizes[b]]]
            for first in range(0, 1 << 30, TRIES):
                slots = np.sort(self._slot(keys[None], np.arange(first, first + TRIES, dtype=np.uint64)[:, None]), axis=1)
                good = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    self.places[b], free[slots[k]] = first + k, False
                    break
        # A bucket of one key names its slot, as a negative number.
        self.places[sizes == 1] = -1 - np.flatnonzero(free)

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (mix(hashes + (place + np.uint64(1)) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        place = self.places[self._bucket(hashes)]
        return np.where(place < 0, -1 - place, self._slot(hashes, place.astype(np.uint64)))


def _ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    stops = np.cumsum(lengths)
    return stops - lengths, stops


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as x:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, x)}
        keys = list(self.ranks)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for key, rank in self.ranks.items():
            self.tokens[rank] = key
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.find = regex.compile(pattern).findall
        self.data = np.frombuffer(b"".join(keys), np.uint8)
        self.key_starts, stops = _ends(np.fromiter(map(len, keys), np.int64, len(keys)))
        hashes = run_hashes(self.data, self.key_starts, stops)
        if len(np.unique(hashes)) < len(keys):
            raise ValueError("two entries of the vocabulary have one hash")
        self.table = PerfectHash(hashes)
        self.of_slot = np.empty(len(keys), np.int64)
        self.of_slot[self.table.slots(hashes)] = np.arange(len(keys))
        self.key_hashes, self.key_lengths, self.ids = hashes, stops - self.key_starts, np.fromiter(self.ranks.values(), np.int32, len(keys))
        self.known = Recent(KEPT)
        self.pairs = [-1] * (1 << 16)  # ranks of two bytes
        for key, r in self.ranks.items():
            if len(key) == 2:
                self.pairs[key[0] << 8 | key[1]] = r

    def look_up(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The id of each run of bytes that is an entry of the vocabulary, and -1 for the others."""
        hashes, lengths = run_hashes(data, starts, stops), stops - starts
        key = self.of_slot[self.table.slots(hashes)]
        at = np.flatnonzero((self.key_hashes[key] == hashes) & (self.key_lengths[key] == lengths))
        n = lengths[at]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(starts[at], n) + step] != self.data[np.repeat(self.key_starts[key[at]], n) + step]
        at = at[np.add.reduceat(differ, np.cumsum(n) - n) == 0] if len(at) else at
        out = np.full(len(starts), -1, np.int32)
        out[at] = self.ids[key[at]]
        return out

    def merged(self, word: bytes) -> list[int]:
        """Ids of a run of bytes: of all neighbours that make an entry, those of the smallest rank, leftmost first, become one."""
        rank, pair, n = self.ranks.get, self.pairs, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a node is named by where it begins; after[k] is where it ends
        heap = [(r, k, k + 2) for k, (x, y) in enumerate(zip(word, word[1:], strict=False)) if (r := pair[x << 8 | y]) >= 0]
        heapify(heap)
        while heap:
            _, k, stop = heappop(heap)
            mid = after[k]
            if mid < 0 or mid >= n or after[mid] != stop:
                continue  # one of the two has grown since
            after[k], after[mid] = stop, -1
            if stop < n:
                before[stop] = k
                end = after[stop]
                if (r := rank(word[k:end])) is not None:
                    heappush(heap, (r, k, end))
            if k:
                first = before[k]
                if (r := rank(word[first:stop])) is not None:
                    heappush(heap, (r, first, stop))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[word[k : after[k]]])
            k = after[k]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has. Each distinct pre-token is looked up once, if not remembered."""
        found = [self.find(t) for t in texts]
        new = self.known.missing(set().union(*found))
        held = self.known.young
        self._learn(list(new), held)
        out = [b"".join(map(held.__getitem__, own)) for own in found]
        self.known.shorten(new)
        return np.frombuffer(b"".join(out), np.int32), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def _learn(self, pieces: list[str], held: dict[str, bytes]) -> None:
        """The packed ids of new pre-tokens: of all by the table, then of those that it does not have, one by one."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        ids = self.look_up(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([np.zeros(1, np.int64), stops])[:-1], stops)
        packed = ids.tobytes()
        for k, (p, known) in enumerate(zip(pieces, (ids >= 0).tolist(), strict=True)):
            held[p] = packed[4 * k : 4 * k + 4] if known else array("i", self.merged(raw[k])).tobytes()


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker: the file is read where texts are encoded, and some ten MB are held."""
    return Vocabulary(path, pattern)


remembers("bytebpe", vocabulary.cache_clear)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    release("bytebpe")
    own = vocabulary(path, pattern)
    for part, texts in blocks(batches):
        ids, counts = own.encode(texts)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    release("bytebpe")
    own = vocabulary(path, pattern)
    for batch in batches:
        column, lo = batch.column(1), 0
        counts = np.diff(column.offsets.to_numpy())
        while lo < len(counts):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(counts[lo:]), GROUP, "right")))
            ids = column.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(own.lengths[ids])])[np.concatenate([[0], np.cumsum(counts[lo:hi])])]
            data = b"".join(map(own.tokens.__getitem__, ids.tolist()))
            held = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), held], names=[*batch.schema.names, "bytes"])
            lo = hi


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of docs(doc_id, text), by the vocabulary of a file that every executor has at `path`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda x: _encode(x, path, pattern), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded(doc_id, ids) with the bytes that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda x: _decode(x, path, pattern), "doc_id bigint, ids array<int>, bytes binary")


def op11_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *file), *file)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))

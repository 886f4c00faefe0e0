"""Texts as arrays: characters, words and their hashes for many documents at once, without a loop over words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are taken together; a longer text is a block of its own.
BLOCK = 500_000


_remembered: dict[str, Callable[[], object]] = {}


def remembers(name: str, forget: Callable[[], object]) -> None:
    """Name what a module remembers between tasks, and how a worker forgets it."""
    _remembered[name] = forget


def release(name: str | None = None) -> None:
    """Forget what other work than the named remembers, and give back what is free: Spark hands workers on to later stages, and the allocators would keep it."""
    for other, forget in _remembered.items():
        if other != name:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches of about BLOCK characters, with their texts; null counts as empty."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.utf8_length(batch.column(text)), 0))
        lo, held = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if held and held + n > BLOCK:
                part = batch.slice(lo, k - lo)
                yield part, [t or "" for t in part.column(text).to_pylist()]
                lo, held = k, 0
            held += n
        if lo < batch.num_rows:
            part = batch.slice(lo)
            yield part, [t or "" for t in part.column(text).to_pylist()]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line end, and where each text starts."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), starts


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 64)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, 0x9E3779B97F4A7C15 | 1, np.uint64)]))
    return _powers


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values in each run [start, end); runs stand in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = mix(values[np.repeat(starts, lengths) + at].astype(np.uint64) + np.uint64(0x1234567)) * powers(int(lengths.max()) + 1)[at]
    return mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def is_space(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


def lower_ascii(c: np.ndarray) -> np.ndarray:
    return np.where((c >= 65) & (c <= 90), c + np.uint32(32), c)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; ASCII letters in lower case.

    A text with fewer words than the width has the one shingle of all its words, or none without words.
    """
    c, at = codes(texts)
    c = lower_ascii(c)
    starts, ends = spans(~is_space(c))
    words = run_hashes(c, starts, ends)
    first = np.searchsorted(starts, at)  # of each text's words
    if len(words) >= width:
        n = len(words) - width + 1
        joined = np.zeros(n, np.uint64)
        for k in range(width):
            joined = mix(joined * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    else:
        joined = np.zeros(0, np.uint64)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(joined[lo : hi - width + 1]))
        else:
            short = np.zeros(1, np.uint64)
            for w in words[lo:hi]:
                short = mix(short * np.uint64(0xD6E8FEB86659FD93) + w + np.uint64(1))
            out.append(short[: hi > lo])
    return out

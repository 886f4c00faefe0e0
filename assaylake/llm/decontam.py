"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared as letters and digits in lower case, with single blanks for all else. An item is found where
all of it, or any WINDOW characters in a row of a longer one, lie in the text with at most BUDGET edits a character. n
characters do with at most k edits only if at least n - Q + 1 - k Q of their q-grams do, on diagonals no further apart than
k. Shared q-grams are counted in overlapping bands of 2 k diagonals, for an item as a whole; in bands that reach the bound
all windows that reach it themselves are verified together by banded alignment, with free ends in the text. Passages of an
item that overlap in the text are one region, with the fewest edits of them.

The items are the query set: they are broadcast in blocks of at most BLOCK_CHARS characters, each block a pass over the
documents; their number of characters is counted first.

Cases: a null text, or one shorter than a pattern, has no region; items of fewer than LEAST characters are found as they are,
between bounds of words; items that are null or without letters and digits have nothing to be found; an item without an id
is found with a null id; repeated items are found each; repeated rows are searched each; without items nothing is found; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from assaylake.llm.common import whole_row
from assaylake.llm.learn import char_hash, letters, lower
from assaylake.llm.textvec import blocks, codes, mix, run_hashes, spans

Q, BUDGET, LEAST, WINDOW, BLOCK_CHARS, FILTER_BITS = 8, 0.08, 24, 120, 2_000_000, 21
#: Diagonals that are first counted together, at least twice a band's (wider bands are not counted so); slots of those counts.
WIDE, SLOT_BITS = 512, 20
KIND = "array<struct<item_id:bigint,start:int,stop:int,edits:int>>"


def normal(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalized code points and where each stands in the text."""
    keep = letters()[raw] | ((raw >= 48) & (raw <= 57))
    c = np.where(keep, lower()[raw], np.uint32(32))
    keep[1:] |= keep[:-1]  # the first of a run of others stays, as a blank
    at = np.flatnonzero(keep)
    return c[at], at


def grams(c: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each position on; 0 where there are fewer. Q is a power of two: runs are doubled."""
    h = char_hash()[c]
    base, n = np.uint64(0x9E3779B97F4A7C15), 1
    while n < Q and len(h) > n:
        h = h[:-n] * base + h[n:]
        base, n = np.uint64(int(base) * int(base) % (1 << 64)), 2 * n
    out = np.zeros(len(c), np.uint64)
    if n == Q:
        out[: len(h)] = h * np.uint64(0xD6E8FEB86659FD93)
    return out


@dataclass
class Patterns:
    item: list[int | None]
    row: np.ndarray  # of the item among the items
    chars: list[np.ndarray]  # of the whole item
    length: np.ndarray  # of the stretches looked for: all of the item, or WINDOW
    allowed: np.ndarray  # edits
    bound: np.ndarray  # shared q-grams
    keys: np.ndarray  # distinct q-gram hashes, sorted
    where: np.ndarray  # starts of their entries
    pattern: np.ndarray  # of each entry
    offset: np.ndarray
    seen: np.ndarray  # filter over the hashes' first bits
    short: dict[int, dict[int, list[tuple[int, int | None, np.ndarray]]]]  # number of words, their hash: row, item, characters


def edits_allowed(n: int) -> int:
    return int(n * BUDGET)


def runs_of_words(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each n words in a row of normalized text, where they start and where they stop."""
    starts, ends = spans(c != 32)
    words = run_hashes(c, starts, ends)
    many = max(len(words) - n + 1, 0)
    h = np.zeros(many, np.uint64)
    for k in range(n if many else 0):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + many])
    return h, starts[:many], ends[n - 1 :]


def patterns(items: pd.DataFrame) -> Patterns | None:
    item, row, chars, length, short = [], [], [], [], {}
    for k, (item_id, text) in enumerate(zip(items["item_id"], items["text"], strict=True)):
        c, _ = normal(codes([text])[0])
        c = c[:-1] if len(c) and c[-1] == 32 else c
        n = len(c)
        if n < LEAST:
            c = c[1:] if n and c[0] == 32 else c
            if len(c):
                words = int((c == 32).sum()) + 1
                short.setdefault(words, {}).setdefault(int(runs_of_words(c, words)[0][0]), []).append((k, item_id, c))
            continue
        # An item that holds more windows than its edits can spoil is never found as a whole without one of them.
        implied = n > WINDOW and n // WINDOW * (edits_allowed(WINDOW) + 1) > edits_allowed(n)
        for m in [n] * (not implied) + [WINDOW] * (n > WINDOW):
            item.append(item_id)
            row.append(k)
            chars.append(c)
            length.append(m)
    if not item and not short:
        return None
    n = np.array(length, np.int64)
    allowed = np.array([edits_allowed(m) for m in length], np.int64)
    hashes = [grams(c)[: len(c) - Q + 1] for c in chars]
    flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(flat, kind="stable")
    keys, where = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    of = np.repeat(np.arange(len(chars)), np.array([len(h) for h in hashes], np.int64))[order]
    offset = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])[order]
    return Patterns(item, np.array(row), chars, n, allowed, np.maximum(n - Q + 1 - allowed * Q, 1), keys, np.append(where, len(flat)), of, offset, seen, short)


def align(own: np.ndarray, begins: np.ndarray, length: int, k: int, text: np.ndarray, diagonal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch own[b : b + length] with at most k edits to a part of the text: edits, start, stop.

    Only alignments within the band of 2 k diagonals are seen. A state is edits * width + diagonal of the start; all
    stretches take a step together. Places outside the text equal nothing, so that using one costs as leaving it out does.
    """
    width = 2 * max(k, 1)
    lo, hi = int(begins[0]) + diagonal, int(begins[-1]) + diagonal + length + width
    seg = np.full(hi - lo, 0xFFFFFFFF, np.uint32)
    a, b = max(lo, 0), min(hi, len(text))
    if a < b:
        seg[a - lo : b - lo] = text[a:b]
    across = np.arange(width, dtype=np.int32)[:, None]
    rise = across * width
    state = np.repeat(across, len(begins), axis=1)
    for i in range(length):
        both = state + np.int32(width) * (seg[across + (begins + i + diagonal - lo)] != own[begins + i])
        np.minimum(both[:-1], state[1:] + width, out=both[:-1])
        state = np.minimum.accumulate(both - rise, axis=0) + rise
        if i % 16 == 15 or i == length - 1:
            live = (state < (k + 1) * width).any(axis=0)
            if not live.all():
                begins, state = begins[live], state[:, live]
            if not len(begins):
                break
    if not len(begins):
        return (np.zeros(0, np.int64),) * 3
    best, end = state.min(axis=0), state.argmin(axis=0)
    return best // width, np.maximum(begins + diagonal + best % width, 0), np.minimum(begins + diagonal + length + end, len(text))


def candidates(p: Patterns, c: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, pattern, first diagonal of the band, offsets of the q-grams shared there) of bands that share enough.

    doc: the text of each position.
    """
    if not len(p.keys):
        return
    h = grams(c)
    at = np.flatnonzero(p.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    key = np.searchsorted(p.keys, h[at])
    ok = p.keys[np.minimum(key, len(p.keys) - 1)] == h[at]
    at, key = at[ok], key[ok]
    count = p.where[key + 1] - p.where[key]
    entry = np.repeat(p.where[key], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    pos = np.repeat(at, count)
    pat, offset = p.pattern[entry], p.offset[entry]
    diagonal = pos - offset
    # First in wide runs of diagonals, in two grids so that no band is cut by both; counts of runs that meet in a slot add up.
    enough = 2 * p.allowed[pat] > WIDE // 2
    for shift in (0, WIDE // 2):
        slot = (pat * 1_000_003 + (diagonal + shift) // WIDE) & ((1 << SLOT_BITS) - 1)
        enough |= np.bincount(slot, minlength=1 << SLOT_BITS)[slot] >= p.bound[pat]
    pos, pat, offset, diagonal = pos[enough], pat[enough], offset[enough], diagonal[enough]
    step = np.maximum(p.allowed[pat], 1)
    band = (diagonal + (1 << 30)) // step
    # Each band as one number: text, pattern, band.
    whole = (doc[pos].astype(np.int64) * len(p.chars) + pat) << 31
    each = np.concatenate([whole + band, whole + band - 1])
    rows, n = np.unique(each, return_counts=True)
    rows = rows[n >= p.bound[(rows >> 31) % len(p.chars)]]
    if not len(rows):
        return
    row = np.minimum(np.searchsorted(rows, each), len(rows) - 1)
    mine = np.flatnonzero(rows[row] == each)
    order = mine[np.argsort(row[mine], kind="stable")]
    offset = np.concatenate([offset, offset])[order]
    edges = np.searchsorted(row[order], np.arange(len(rows) + 1)).tolist()
    for k, r in enumerate(rows.tolist()):
        d, pattern = divmod(r >> 31, len(p.chars))
        yield d, pattern, (r & ((1 << 31) - 1)) * max(int(p.allowed[pattern]), 1) - (1 << 30), offset[edges[k] : edges[k + 1]]


def passages(p: Patterns, pat: int, text: np.ndarray, diagonal: int, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, edits) in a band of the text, where the pattern's q-grams at the offsets are."""
    own, k, m = p.chars[pat], int(p.allowed[pat]), int(p.length[pat])
    lo, hi = max(diagonal, 0), min(diagonal + 2 * max(k, 1) + len(own), len(text))
    at = text[lo:hi].tobytes().find(own.tobytes()) if hi > lo else -1
    if at >= 0 and at % 4 == 0:  # all windows of it are as they are
        return [(lo + at // 4, lo + at // 4 + len(own), 0)]
    has = np.zeros(len(own) - Q + 2, np.int64)
    has[offsets + 1] = 1
    upto = np.cumsum(has)
    begins = np.flatnonzero(upto[m - Q + 1 :] - upto[: len(upto) - (m - Q + 1)] >= p.bound[pat])
    if not len(begins):
        return []
    edits, start, stop = align(own, begins, m, k, text, diagonal)
    return [x for x in zip(start.tolist(), stop.tolist(), edits.tolist(), strict=True) if x[0] < x[1]]


def exact(p: Patterns, c: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int | None, int, int]]:
    """(text, row, item, start, stop) of short items."""
    for n, known in p.short.items():
        h, starts, stops = runs_of_words(c, n)
        hit = np.flatnonzero(np.isin(h, np.array(list(known), np.uint64)))
        hit = hit[doc[starts[hit]] == doc[stops[hit] - 1]]
        for code, a, b, d in zip(h[hit].tolist(), starts[hit].tolist(), stops[hit].tolist(), doc[starts[hit]].tolist(), strict=True):
            for row, item, own in known[code]:
                if np.array_equal(own, c[a:b]):
                    yield d, row, item, a, b


def find(p: Patterns, texts: list[str]) -> list[list[dict]]:
    raw, starts = codes(texts)
    c, at = normal(raw)
    edges = np.searchsorted(at, starts)
    doc = np.repeat(np.arange(len(texts)), np.diff(edges))
    held: dict[tuple[int, int, int | None], set[tuple[int, int, int]]] = {}
    for d, row, item, a, b in exact(p, c, doc):
        held.setdefault((d, row, item), set()).add((a - int(edges[d]), b - int(edges[d]), 0))
    for d, pat, diagonal, offsets in candidates(p, c, doc):
        lo = int(edges[d])
        if got := passages(p, pat, c[lo : edges[d + 1]], diagonal - lo, offsets):
            held.setdefault((d, int(p.row[pat]), p.item[pat]), set()).update(got)
    out: list[list[dict]] = [[] for _ in texts]
    for (d, _, item), some in held.items():
        lo, whole = int(edges[d]), []
        for a, b, edits in sorted(some):
            if whole and a < whole[-1][1]:
                whole[-1] = (whole[-1][0], max(b, whole[-1][1]), min(edits, whole[-1][2]))
            else:
                whole.append((a, b, edits))
        out[d] += [{"item_id": item, "start": int(at[lo + a] - starts[d]), "stop": int(at[lo + b - 1] + 1 - starts[d]), "edits": n} for a, b, n in whole]
    return [sorted(x, key=lambda r: (r["start"], r["item_id"] is None, r["item_id"] or 0, r["stop"])) for x in out]


def regions(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with a column `regions`: item_id, start and stop in code points, edits. A column of that name is replaced."""
    return _found(spark, docs.drop("regions"), benchmark).select("row.*", "regions")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a region, as they are, whatever their columns are called."""
    return _found(spark, docs, benchmark).filter(F.size("regions") == 0).select("row.*")


def _found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row (a row of docs as one column), text, regions."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-chars // BLOCK_CHARS))
    out = docs.select(whole_row(docs), "text", F.array().cast(KIND).alias("regions"))
    for k in range(passes):  # more than one only for a benchmark of millions of characters
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        p = patterns(pd.DataFrame({"item_id": pd.Series([r["item_id"] for r in own], dtype=object), "text": pd.Series([r["text"] for r in own], dtype=object)}))
        if p is None:
            continue
        shared = spark.sparkContext.broadcast(p)
        schema = StructType([*out.schema.fields[:2], StructField("before", out.schema["regions"].dataType), StructField("regions", out.schema["regions"].dataType)])
        found = out.withColumnRenamed("regions", "before").mapInArrow(lambda x, shared=shared: _with_regions(x, shared.value), schema)
        out = found.select("row", "text", F.concat("before", "regions").alias("regions"))
    return out


def _with_regions(batches: Iterator[pa.RecordBatch], p: Patterns) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))
    for part, texts in blocks(batches, 1):
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(find(p, texts), kind)], names=[*part.schema.names, "regions"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = regions(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["item_id"])))
    return found.select("doc_id", (F.size("regions") > 0).alias("contaminated"), F.size("regions").cast("long").alias("n_regions"), items.alias("item_ids"))

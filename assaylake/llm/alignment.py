"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and how often two ids are linked.

Tokenizer A is byte-level BPE of the text with a space before it; B is a piece model that adds that space itself. Both cut the
same bytes. The tokens of both are the two sides of a graph in which overlapping tokens are joined. Its connected components, found
by union-find, are the minimal groups: they lie one behind another, and two neighbours part where a token of A and one of B both end.
All pairs of a group's members, one of A and one of B, are links. Where the tokenizers' files show that neither joins what a space parts,
so that no group does, the graph is that of words: each new word of some hundred texts is aligned once, all of them together, and
remembered. Other tokenizers get whole texts.

Each document's distinct pairs of ids go, with the number of times, into a table. The count of a pair is the number of documents
that hold it, summed by Spark. The most frequent pairs, at most FEW, are broadcast to the documents, as they would be hot
keys; all others are joined by shuffle. Both ways give the same, and where the line lies changes nothing.

Cases: a null or empty text, and one whose tokens do not spell the space and the text (as with U+2581 in it), has no tokens;
strings of special tokens are plain text; a very long group is expanded over its distinct ids; rows that repeat a doc_id get a row
each and count each as a document; a null doc_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import written
from assaylake.llm.textvec import blocks, release, remembers
from assaylake.llm.tokens import Recent

#: Pairs of ids that are broadcast (about 40 bytes each), and links of a group beyond which its distinct ids are expanded instead.
FEW, MANY = 300_000, 4096
#: Words that a worker remembers in each of two generations, short ones alone; a text is cut at a space behind anything but white space.
WORDS, PARTED = 150_000, re.compile(r"(?<=\S) (?!\Z)")
#: A pair of ids as one number: a * SIZE + b.
SIZE = 1 << 32
ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])
ALIGNED_DDL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
GROUPS_DDL = "doc_id bigint, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>"


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte = _byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [(k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in pieces]
        self.a_lengths, self.b_lengths = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # What an id adds to the text of the groups: itself, and the mark that follows it.
        self.marked = [f"{k}{mark}" for n, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for mark in marks for k in range(n)]

        self.size = max(1, (len(self.b_bytes) - 1).bit_length())  # bits of an id of B
        self.words, self.by_words = Recent(WORDS), self._parts_at_spaces(a_path, [p for _, p in pieces])

    def _parts_at_spaces(self, a_path: str, pieces: list[str]) -> bool:
        """Whether neither tokenizer ever joins what a space parts that follows anything but white space, by their files."""
        with open(a_path, encoding="utf-8") as x:
            file = json.load(x)
        split = file.get("pre_tokenizer") or {}
        a = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not any(file.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")) and not file["model"].get("dropout")
        # A piece has its spaces first; and spaces, one behind another and at the end, are kept, and nothing is normalized.
        b = not any("▁" in p.lstrip("▁") for p in pieces) and all(self._spelt_b(t) == f" {t}" for t in ("  a  b ", "\ufb01 \u2460 A\u030a\u3000\xa0x"))
        return bool(a and b)

    def _spelt_b(self, text: str) -> str:
        return b"".join(map(self.b_bytes.__getitem__, self.b.encode(text))).decode("utf-8", "replace")

    def split(self, texts: list[str]) -> list[list[str]]:
        """The words of each text: what stands between spaces that follow anything but white space; a whole text where that does not hold."""
        return [PARTED.split(t) for t in texts] if self.by_words else [[t] for t in texts]

    def _joined(self, words: list[str], whole: bytes, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A of all words, encoded as one text and cut by bytes, and how many each has; None if a word is not spelt."""
        parts = [np.array(self.a.encode_batch_fast([" " + " ".join(words[lo : lo + 8192])], add_special_tokens=False)[0].ids, np.int64) for lo in range(0, len(words), 8192)]
        ids = np.concatenate([np.zeros(0, np.int64), *parts])
        ends = np.cumsum(self.a_lengths[ids])
        at = np.searchsorted(ends, stops)
        if b"".join(map(self.a_bytes.__getitem__, ids.tolist())) != whole or (ends[at] != stops).any():
            return None
        return ids, np.diff(at + 1, prepend=0)

    def encode(self, texts: list[str], joined: bool = False) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """For both the ids of all texts, one after another, and how many each has; and which texts both spell, behind a space. Others have none.

        Words that end in something but white space may be encoded joined.
        """
        raw = [f" {t}".encode() for t in texts]
        whole, stops = b"".join(raw), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        b = self.b.encode(texts, num_threads=1)
        left = self._joined(texts, whole, stops) if joined and texts else None
        b_counts = np.fromiter(map(len, b), np.int64, len(b))
        right = np.fromiter(chain.from_iterable(b), np.int64, int(b_counts.sum()))
        spelt = np.append(0, np.cumsum(self.b_lengths[right]))[np.cumsum(b_counts)]
        if left is not None and np.array_equal(spelt, stops) and b"".join(map(self.b_bytes.__getitem__, right.tolist())) == whole:
            return left, (right, b_counts), np.ones(len(texts), bool)
        a, good = [x.ids for x in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], np.zeros(len(texts), bool)
        for k, w in enumerate(raw):
            good[k] = len(w) > 1 and b"".join(map(self.a_bytes.__getitem__, a[k])) == w and b"".join(map(self.b_bytes.__getitem__, b[k])) == w
            if not good[k]:
                a[k] = b[k] = []
        flat = lambda x, n: np.fromiter(chain.from_iterable(x), np.int64, int(n.sum()))
        a_counts, b_counts = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        return (flat(a, a_counts), a_counts), (flat(b, b_counts), b_counts), good

    def remember(self, words: list[str]) -> None:
        plain = [w for w in words if self.by_words and w and not w[-1].isspace()]
        if plain:
            self.learn(plain, True)
        if len(plain) < len(words):
            self.learn(sorted(set(words).difference(plain)), False)

    def learn(self, words: list[str], joined: bool) -> None:
        """Align new words: the text of a word's groups, its linked pairs, its numbers of tokens, groups and links, and how often pairs occur if not once each."""
        (a, words_a), (b, words_b), good = self.encode(words, joined)
        of_a, of_b = grouped(self.a_lengths[a], self.b_lengths[b])
        n = int(of_a[-1]) + 1 if len(of_a) else 0
        n_a, n_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        word = np.repeat(np.arange(len(words)), words_a)[np.cumsum(n_a) - n_a]  # of each group
        # The text of the groups: each token goes behind those of its own side and of the groups before.
        code = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (of_a, of_b))
        code[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[of_a]] = a + last_a * len(self.a_bytes)
        code[np.arange(len(b)) + np.cumsum(n_a)[of_b]] = 2 * len(self.a_bytes) + b + last_b * len(self.b_bytes)
        marks, ends = list(map(self.marked.__getitem__, code.tolist())), np.cumsum(words_a + words_b).tolist()
        of, pair, times = _links(a, b, of_a, of_b, n_a, n_b, word, self.size)
        links = np.bincount(word, n_a * n_b, len(words)).astype(np.int64)
        numbers = np.stack([words_a, words_b, np.bincount(word, minlength=len(words)), links], axis=1).tobytes()
        at = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        once = np.bincount(word, n_a * n_b > MANY, len(words)) == 0
        pairs, times, held = pair.tobytes(), times.tobytes(), self.words.young
        for k, (w, lo, hi) in enumerate(zip(words, [0, *ends], ends, strict=False)):
            span = slice(8 * at[k], 8 * at[k + 1])
            held[w] = ("".join(marks[lo:hi])[:-1], pairs[span], numbers[32 * k : 32 * k + 32], None if once[k] else times[span]) if good[k] else None


@cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


remembers("alignment", tokenizers.cache_clear)


def united(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes, by union-find over all edges (u, v) together.

    In each round the larger root of an edge is hung below the smaller; of several edges that would hang one root, one does, and the
    others wait. Then paths are halved until every node points to its root, and edges within a tree go.
    """
    parent = np.arange(n)
    while len(u):
        parent[np.maximum(u, v)] = np.minimum(u, v)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        u, v = parent[u], parent[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return parent


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... counts[k] numbers for each k."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def grouped(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B, given their numbers of bytes, the number of its group; both cover the same bytes."""
    n, a_stops, b_stops = len(a_lengths), np.cumsum(a_lengths), np.cumsum(b_lengths)
    first = np.searchsorted(b_stops, a_stops - a_lengths, "right")  # of the tokens of B that overlap one of A
    counts = np.searchsorted(b_stops - b_lengths, a_stops, "left") - first
    roots = united(n + len(b_lengths), np.repeat(np.arange(n), counts), n + _runs(first, counts))
    # A root is the first token of A in its group, and groups lie one behind another.
    number = np.cumsum(roots[:n] == np.arange(n)) - 1
    return number, number[roots[n:]]


def _links(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, pair and times of all links in order of words; `word` is that of each group, a pair a << bits | b. Very wide groups have each pair of ids once."""
    wide = n_a * n_b > MANY
    sides = []
    for ids, of in ((a, of_a), (b, of_b)):
        group, own, times = of, ids, np.ones(len(ids), np.int64)
        if wide.any():
            inside = wide[of]
            found, n = np.unique(np.stack([of[inside], own[inside]]), axis=1, return_counts=True)
            group, own, times = (np.concatenate([x[~inside], y]) for x, y in ((of, found[0]), (own, found[1]), (times, n)))
            order = np.argsort(group, kind="stable")
            group, own, times = group[order], own[order], times[order]
        sides.append((group, own, times))
    (group, left, left_times), (other, right, right_times) = sides
    counts = np.bincount(other, minlength=len(word))
    at = _runs((np.cumsum(counts) - counts)[group], counts[group])
    counts = counts[group]
    return np.repeat(word[group], counts), np.repeat(left << bits, counts) | right[at], np.repeat(left_times, counts) * right_times[at]


def _counted(of: np.ndarray, pair: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of each `of` once, in order, with the sum of its times; without times each counts once."""
    if not len(pair):
        return of, pair, np.zeros(0, np.int64)
    bits = int(pair.max()).bit_length()
    if int(of[-1] if times is None else of.max()).bit_length() + bits < 63:
        key = (of << bits) | pair
        if times is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        kept = key[new]
        of, pair = kept >> bits, kept & ((1 << bits) - 1)
    else:
        order = np.lexsort((pair, of))
        of, pair, times = of[order], pair[order], None if times is None else times[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])))
        key, of, pair = pair, of[new], pair[new]
    return of, pair, np.diff(np.append(new, len(key))) if times is None else np.add.reduceat(times, new)


def _align(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    release("alignment")
    own = tokenizers(a_path, b_path)
    for part, texts in blocks(batches):
        split = own.split(texts)
        new = own.words.missing(set(chain.from_iterable(split)))
        own.remember(list(new))
        held, digests, sizes = own.words.young, [], []
        pairs, numbers, times = [], [], []
        for t, words in zip(texts, split, strict=True):
            found = [held[w] for w in words] if t else [None]
            if None in found:  # a word, and so the text, that is not spelt
                digests.append("")
                sizes.append(0)
                continue
            marks, own_pairs, own_numbers, own_times = zip(*found, strict=True)
            digests.append(hashlib.sha256(";".join(marks).encode()).hexdigest())
            sizes.append(len(found))
            pairs += own_pairs
            numbers += own_numbers
            times += own_times
        own.words.shorten(new)
        doc, ends = np.repeat(np.arange(len(texts)), sizes), np.append(0, np.cumsum(sizes))  # of each word, and the words of each text
        upto = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(np.frombuffer(b"".join(numbers), np.int64).reshape(-1, 4), axis=0)])
        sums = upto[ends[1:]] - upto[ends[:-1]]
        lengths = np.fromiter(map(len, pairs), np.int64, len(pairs)) // 8
        weights = None
        if len(set(times)) > 1:  # a word with a very wide group
            weights = np.concatenate([np.ones(n, np.int64) if t is None else np.frombuffer(t, np.int64) for n, t in zip(lengths.tolist(), times, strict=True)])
        of, pair, count = _counted(np.repeat(doc, lengths), np.frombuffer(b"".join(pairs), np.int64), weights)
        pair = (pair >> own.size) * SIZE + (pair & ((1 << own.size) - 1))
        offsets = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32))
        columns = [part.column(0), *(pa.array(x) for x in sums.T), pa.array(digests, pa.string()), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pair, count))]
        yield pa.RecordBatch.from_arrays(columns, names=ALIGNED.names)


def _groups(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    release("alignment")
    own = tokenizers(a_path, b_path)
    for part, texts in blocks(batches):
        rows = []
        for a, b in zip(*(np.split(ids, np.cumsum(counts)[:-1]) for ids, counts in own.encode(texts)[:2]), strict=True):
            of_a, of_b = grouped(own.a_lengths[a], own.b_lengths[b]) if len(a) else (np.zeros(0, np.int64),) * 2
            rows.append((a, b, np.cumsum(np.bincount(of_a)), np.cumsum(np.bincount(of_b))))
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in zip(*rows, strict=True))], names=["doc_id", "a_ids", "b_ids", "a_stops", "b_stops"])


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, and for each group the number of ids of A, and of B, up to its end."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda x: _groups(x, a_path, b_path), GROUPS_DDL)


def aligned(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A written table of ALIGNED for each row of docs(doc_id, text), with a number of its own, `row`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.mapInArrow(lambda x: _align(x, a_path, b_path), ALIGNED_DDL)
    return written(spark, found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Of aligned documents: pair, a, b, n (the documents that hold the pair) and best (no other pair of its id of A has more)."""
    counts = written(spark, found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "aligned-counts")
    counts = counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(SIZE - 1)).alias("b"), "n")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A, whatever the corpus
    return counts.join(F.broadcast(most), "a").withColumn("best", F.col("n") == F.col("most")).drop("most")


def align(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, few: int = FEW) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = aligned(spark, docs, a_path, b_path)
    counts = pair_counts(spark, found).select("pair", "n", "best")

    # Pairs are frequent from a power of two on; the lowest with no more than `few` pairs from there on.
    power = F.floor(F.log2("n")).cast("int")
    total, least = 0, 63
    for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("held")).orderBy(F.col("power").desc()).collect():  # 63 rows at most
        total += r["held"]
        if total > few:
            break
        least = r["power"]
    often = F.col("n") >= F.lit(2.0**least)
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("c")).select("row", F.col("c.pairs").alias("pair"), F.col("c.times").alias("times"))
    hot = F.broadcast(counts.filter(often))  # `few` rows at most
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    parts = [links.join(hot, "pair").groupBy("row").agg(*sums), links.join(hot, "pair", "left_anti").join(counts.filter(~often), "pair").groupBy("row").agg(*sums)]
    sums = parts[0].unionByName(parts[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

"""Token ids in a content-addressed store.

Every document's ids, with the end id, are cut into chunks where a rolling hash over the last WINDOW ids says so, so
that passages two documents share give the same chunks wherever they stand. The store has two kinds of files:

- packs: each distinct chunk once. Magic, then for each chunk its 16-byte BLAKE2b digest, the number of ids (u32) and
  the ids, little-endian, in 2 bytes where the vocabulary allows it and else in 4.
- recipes, in ascending doc_id order over the files in order of their numbers: for each document doc_id (i64; the
  smallest i64 stands for null), start (i64, ids of all documents before it), n_tokens (i64), the number of chunks
  (u32), its Merkle root (32 bytes, SHA-256, over the chunk digests), then digest and number of ids of each chunk.

A manifest for each kind lists the committed files with their digests, and the Merkle root over them; files of lost or
repeated attempts are in no manifest. Reading verifies each chunk against its digest, each recipe against its root
and each file against the manifest.

Cases: a null text has the end id alone; repeated rows have a recipe each, side by side; a null doc_id comes first;
an empty table gives manifests without files; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import discard, partitions, ranged, running_sums, work_path, written
from assaylake.llm.textvec import release, remembers

PACK_MAGIC, RECIPE_MAGIC = b"ALPACK1\n", b"ALRECP1\n"
PACK_HEAD, RECIPE_HEAD, RECIPE_CHUNK = struct.Struct("<16sI"), struct.Struct("<qqqI32s"), struct.Struct("<16sI")
NO_ID = -(2**63)
ASCII = frozenset(map(chr, range(128)))
#: The rolling hash sees WINDOW ids; a chunk has LEAST to MOST ids and ends about every 2^CUT_BITS ids beyond LEAST.
WINDOW, CUT_BITS, LEAST, MOST = 8, 9, 64, 4096
#: Words and digests of chunks in each of the two generations that a worker keeps, and the longest word kept: about 100 MB at most.
WORDS, DIGESTS, LONG = 200_000, 100_000, 64
#: Code points of documents that are taken together; a longer one is taken alone.
GROUP = 500_000
POOL_SCHEMA = "digest binary, n_ids bigint, crc bigint"
RECIPE_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, digests array<binary>, lengths array<bigint>, ends array<bigint>"


@cache
def _gear() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**63, 1 << 16, dtype=np.uint64)


class Recent:
    """A mapping in two generations: what is not asked for while `size` entries come in is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.older = size, {}, {}

    def turn(self) -> None:
        """Begin a new generation where the young one is full."""
        if len(self.young) > self.size:
            self.older, self.young = self.young, {}

    def known(self, new: set) -> set:
        """Bring what is known of keys that the young generation lacks into it, and return the others."""
        if self.older:
            known = [k for k in new if k in self.older]
            self.young.update((k, self.older[k]) for k in known)
            new.difference_update(known)
        return new

    def missing(self, keys: set) -> set:
        """Bring what is known of the keys into the young generation, and return the others."""
        self.turn()
        return self.known(keys.difference(self.young))

    def shorten(self, keys: set) -> None:
        """Forget the long ones of these keys: entries have a greatest size."""
        for k in keys:
            if len(k) > LONG:
                del self.young[k]


class Encoder:
    """Ids of texts by the tokenizers library, word by word.

    The normalizer and the splitter of the word vocabulary never join what blanks and line ends part, so the ids of a text
    are those of its words. Words of ASCII and Latin-1 letters are taken apart here as the splitter does, and many distinct parts
    that are new go through the library's model as one text: a part's last id, and no other, is one of those that end a part. All
    other words go through the whole library, and so do those of a vocabulary without such ids. A vocabulary whose file names
    another normalizer or splitter gets its texts whole.
    """

    PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")

    #: Only the blanks that texts are split at are named: some of Python's white space is none to the vocabulary.
    RUNS = re.compile("[^ \t\n\ra-z0-9\xdf-\xf6\xf8-\xff][.,][ \n]")
    #: The normalizer and the splitter that all this holds for, as the file has them.
    KNOWN = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "post_processor": None,
    }

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer(self.whole.model)  # for parts between blanks: no normalizer, no special tokens
        self.parts.pre_tokenizer = CharDelimiterSplit(" ")
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 << 8 * self.width if self.width == 2 else self.whole.get_vocab_size(), bool)
        self.ends[[i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        # Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on; 0 to 32 are the first.
        byte = {b: chr(0x100 + k) for k, b in enumerate([*range(33), *range(0x7F, 0xA1), 0xAD])}
        self.written = {chr(c): "".join(byte.get(b, chr(b)) for b in chr(c).encode()) for c in range(0x80, 0x100)}
        self.words = Recent(WORDS)
        with open(path, encoding="utf-8") as x:
            file = json.load(x)
        marked = all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in file["added_tokens"])
        self.known = marked and all(file.get(k) == v for k, v in self.KNOWN.items()) and not file.get("truncation") and not file.get("padding")
        del file

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _learn(self, new: set[str]) -> set[str]:
        """Put new words among the young ones, and parts of words that are not known; returns what was put there."""
        words = self.words.young
        plain = [w for w in new if (w.isascii() and w.isprintable() or self.PLAIN.fullmatch(w)) and "<|" not in w] if self.ends.any() else []
        whole = {w for w in plain if w.isalpha() and w.islower()}  # a part of its own
        split = {w: self.PARTS.findall(w.lower()) for w in plain if w not in whole}
        parts = self.words.known(set(chain.from_iterable(split.values())).difference(words, whole)) | whole
        every = list(parts)
        for lo in range(0, len(every), 4096):
            some = every[lo : lo + 4096]
            text = " ".join(some)
            for c in set(text).difference(ASCII):
                text = text.replace(c, self.written[c])
            ids = np.array(self.parts.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            data, at = ids.tobytes(), [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()]
            words.update(zip(some, [data[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        words.update({w: b"".join([words[p] for p in own]) for w, own in split.items()})
        others = list(new.difference(plain))
        words.update((w, self.packed(x.ids)) for w, x in zip(others, self.whole.encode_batch_fast(others, add_special_tokens=False), strict=True))
        return parts | new

    def joined(self, texts: list[str], tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other and each with the packed tail behind it, and how many each text then has.

        Texts are taken together: each distinct word is looked up once, and ids are gathered by the numbers of words.
        """
        if not self.known:
            packed = [self.packed(x.ids) + tail for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.frombuffer(b"".join(packed), self.kind), np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        clean = []
        for text in texts:
            # Case folding is the normalizer's own; done before, it spares entries. Special tokens keep their case.
            if "<|" not in text and (text.isascii() or _latin_1(text)):
                text = text.lower()
                if not self.RUNS.search(text):  # stops and commas then are parts of their own, and need not make words of their own
                    text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
            clean.append(text.replace("\n", " ").replace("\t", " ").replace("\r", " "))
        clean.append("")  # no word has a line end by now: one stands behind each text
        every = pc.split_pattern(pa.array([" \n ".join(clean)], pa.large_string()), " ").values.dictionary_encode()
        distinct, number = every.dictionary.to_numpy(zero_copy_only=False).tolist(), every.indices.to_numpy()
        self.words.turn()
        words = self.words.young
        words[""], words["\n"] = b"", tail
        packed = list(map(words.get, distinct))
        if new := {w for w, x in zip(distinct, packed, strict=True) if x is None}:
            put = self._learn(self.words.known(new))
            packed = [words[w] if x is None else x for w, x in zip(distinct, packed, strict=True)]
            self.words.shorten(put)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        first, pool = np.cumsum(size) - size, np.frombuffer(b"".join(packed), self.kind)
        sizes = size[number]
        stops = np.cumsum(sizes)
        ids = pool[np.repeat(first[number] - stops + sizes, sizes) + np.arange(int(sizes.sum()))]
        return ids, np.diff(stops[number == distinct.index("\n")], prepend=0) if texts else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        ids, lengths = self.joined(texts)
        data, at = ids.tobytes(), [0, *(np.cumsum(lengths) * self.width).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def _latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, Encoder] = {}
remembers("tokens", _encoders.clear)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """For each document, given where it starts among all ids, the ends of its chunks.

    The window reaches into the document before only within LEAST of a start, where nothing is cut.
    """
    mixed = _gear()[ids.astype(np.uint32) & 0xFFFF]
    rolled = mixed.copy()
    for k in range(1, WINDOW):
        rolled[k:] += mixed[:-k] << np.uint64(k)
    marks = np.flatnonzero((rolled >> np.uint64(40)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    ends = [*starts[1:].tolist(), len(ids)]
    at = np.searchsorted(marks, starts, "right")
    marks = marks.tolist()
    out = []
    for begin, end, k in zip(starts.tolist(), ends, at.tolist(), strict=True):
        own, last = [], begin
        while end - last > LEAST:
            while k < len(marks) and marks[k] < last + LEAST:
                k += 1
            last = min(marks[k] if k < len(marks) else end, last + MOST, end)
            own.append(last)
        if last < end or not own:
            own.append(end)
        out.append(own)
    return out


STAGED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64())), ("file", pa.string()), ("offsets", pa.list_(pa.int64()))])


def _stage(batches: Iterator[pa.RecordBatch], path: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Encode, and put the chunks that are new to the task into a file of its own; rows say where each chunk lies.

    Rows of a lost or repeated attempt never reach the table, so nothing refers to its file.
    """
    release("tokens")
    enc = encoder(path)
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    file = f"{uuid.uuid4().hex}.bin"
    with store.open_output_stream(f"{at}/{file}", compression=None) as out:
        yield from _chunks(batches, enc, end_id, file, out)


def _chunks(batches: Iterator[pa.RecordBatch], enc: Encoder, end_id: int, file: str, out) -> Iterator[pa.RecordBatch]:
    written_to = 0
    end, width = np.array([end_id], enc.kind).tobytes(), enc.width
    seen = Recent(DIGESTS)  # chunks that this task has handed on; one forgotten is put aside again, and the packs hold it once
    for doc_ids, texts in _groups(batches):
        ids, lengths = enc.joined(texts, end)
        ends = cuts(ids, np.cumsum(lengths) - lengths)
        data, at = ids.tobytes(), [0, *(stop * width for stop in chain.from_iterable(ends))]
        pieces = [(hashlib.blake2b(x, digest_size=16).digest(), x) for x in (data[a:b] for a, b in zip(at, at[1:], strict=False))]
        new = seen.missing({d for d, _ in pieces})
        offsets: list[int | None] = []
        for digest, piece in pieces:
            if digest in new:
                new.remove(digest)
                seen.young[digest] = None
                offsets.append(written_to)
                out.write(piece)
                written_to += len(piece)
            else:
                offsets.append(None)
        rows, k = [], 0
        for doc_id, n, own in zip(doc_ids, lengths.tolist(), ends, strict=True):
            mine = slice(k, k := k + len(own))
            rows.append((doc_id, n, [d for d, _ in pieces[mine]], [len(x) // width for _, x in pieces[mine]], file, offsets[mine]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STAGED, strict=True)], schema=STAGED)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts, about GROUP code points at a time."""
    for batch in batches:
        lo, held = 0, 0
        lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
        for k, n in enumerate([*lengths, GROUP + 1]):
            if k > lo and held + n > GROUP:
                yield batch.column(0)[lo:k].to_pylist(), [t or "" for t in batch.column(1)[lo:k].to_pylist()]
                lo, held = k, 0
            held += n


# --- files


FILES = "number bigint, name string, width bigint, sha256 string"


def _root(digests: list[bytes]) -> bytes:
    """The root of the binary Merkle tree over the digests: leaves under a zero byte, inner nodes under a one; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\x00" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


class StoreWriter:
    def __init__(self, options: dict):
        self.path, self.table, self.width, self.chunks = options["path"].rstrip("/"), options["table"], int(options["width"]), options.get("chunks")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each file written; of a lost or repeated attempt no row arrives."""
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        files, out, source, opened = [], None, None, None

        def close():
            if out is not None:
                out.close()
                files[-1]["sha256"] = check.hexdigest()

        for batch in iterator:
            rows = batch.to_pylist()
            for row in rows:
                number = row.get("pid", 0)
                if out is None or files[-1]["number"] != number:
                    close()
                    files.append({"number": number, "name": f"{self.table}-{number:06d}-{uuid.uuid4().hex}.bin", "width": self.width})
                    out, check = store.open_output_stream(f"{folder}/{files[-1]['name']}", compression=None), hashlib.sha256()
                    data = PACK_MAGIC if self.table == "packs" else RECIPE_MAGIC
                    out.write(data)
                    check.update(data)
                if self.table == "packs":
                    if opened != row["file"]:  # rows come by file and offset
                        source, opened = _reader(self.chunks, row["file"]), row["file"]
                    source.seek(row["offset"])
                    data = PACK_HEAD.pack(row["digest"], row["length"]) + source.read(row["length"] * self.width)
                else:
                    own = row["digests"]
                    doc_id = NO_ID if row["doc_id"] is None else row["doc_id"]
                    data = RECIPE_HEAD.pack(doc_id, row["start"], row["n_tokens"], len(own), _root(own)) + b"".join(map(RECIPE_CHUNK.pack, own, row["lengths"]))
                out.write(data)
                check.update(data)
        close()
        if files:
            yield pa.RecordBatch.from_pylist(files, pa.schema([("number", pa.int64()), ("name", pa.string()), ("width", pa.int64()), ("sha256", pa.string())]))


def _commit(path: str, table: str, rows: list) -> None:
    """Write the manifest: files are as many as tasks wrote."""
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    files = sorted((r.asDict() for r in rows), key=lambda f: (f["number"], f["name"]))
    root = _root([bytes.fromhex(f["sha256"]) for f in files]).hex()
    with store.open_output_stream(f"{folder}/{table}.json.part", compression=None) as out:
        out.write(json.dumps({"root": root, "files": files}).encode())
    store.move(f"{folder}/{table}.json.part", f"{folder}/{table}.json")


def _reader(folder: str, file: str) -> io.BufferedReader:
    store, at = fs.FileSystem.from_uri(folder)
    return io.BufferedReader(store.open_input_file(f"{at}/{file}"), 1 << 20)


class StoreReader:
    def __init__(self, options: dict):
        self.path, self.table = options["path"].rstrip("/"), options["table"]

    def files(self) -> list[dict]:
        store, folder = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{folder}/{self.table}.json") as x:
            manifest = json.loads(x.read())
        if _root([bytes.fromhex(f["sha256"]) for f in manifest["files"]]).hex() != manifest["root"]:
            raise ValueError(f"{self.table}: the manifest's root is not that of its files")
        return manifest["files"]

    def read_all(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                yield from self.read(file)

    def read(self, file: dict) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(self.path)
        check = hashlib.sha256()
        with store.open_input_stream(f"{folder}/{file['name']}", buffer_size=1 << 20) as source:

            def take(n: int) -> bytes:
                data = source.read(n)
                check.update(data)
                return data

            take(len(PACK_MAGIC))
            yield from (self._packs if self.table == "packs" else self._recipes)(take, file["width"])
        if check.hexdigest() != file["sha256"]:
            raise ValueError(f"{file['name']} is not what was written")

    def _packs(self, take, width: int) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("n_ids", pa.int64()), ("crc", pa.int64())])
        rows: list[tuple] = []
        while head := take(PACK_HEAD.size):
            digest, n = PACK_HEAD.unpack(head)
            data = take(n * width)
            if hashlib.blake2b(data, digest_size=16).digest() != digest:
                raise ValueError("a chunk is not what its digest says")
            rows.append((digest, n, zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())))
            if len(rows) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def _recipes(self, take, width: int) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
        rows: list[tuple] = []
        while head := take(RECIPE_HEAD.size):
            doc_id, start, n_tokens, n, root = RECIPE_HEAD.unpack(head)
            own = list(RECIPE_CHUNK.iter_unpack(take(n * RECIPE_CHUNK.size)))
            if _root([d for d, _ in own]) != root:
                raise ValueError(f"the recipe of document {doc_id} is not what its root says")
            rows.append((None if doc_id == NO_ID else doc_id, start, n_tokens, [d for d, _ in own], [k for _, k in own], list(accumulate(k for _, k in own))))
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# --- CRC-32 of joined pieces: x^(8 n) times a checksum, modulo the polynomial, for many pieces at once


def _times(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@cache
def _byte_powers() -> list[np.ndarray]:
    """Matrix k shifts a checksum by 2^k zero bytes."""
    one = np.array([0xEDB88320, *(1 << k for k in range(31))], np.uint32)
    for _ in range(3):
        one = _times(one, one)
    powers = [one]
    for _ in range(47):
        powers.append(_times(powers[-1], powers[-1]))
    return powers


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each checksum adds to that of a text in which n_bytes follow the piece."""
    out, left, k = crc.astype(np.uint32), n_bytes.astype(np.int64), 0
    while left.any():
        odd = left & 1 == 1
        out[odd] = _times(_byte_powers()[k], out[odd])
        left, k = left >> 1, k + 1
    return out


def _shifted(crc: pd.Series, n_bytes: pd.Series) -> pd.Series:
    return pd.Series(shifted(crc.to_numpy(), n_bytes.to_numpy()).astype(np.int64))


# --- the operator


def _width(spark: SparkSession, tokenizer: str) -> int:
    """Bytes of an id, asked of an executor: the vocabulary is not loaded on the driver."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoder(tokenizer).width], pa.int64())], names=["width"])

    return spark.range(0, 1, 1, 1).mapInArrow(ask, "width bigint").first()["width"]


def write_store(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the store of docs(doc_id, text) to a folder of the shared store."""
    width = _width(spark, tokenizer)
    aside = work_path(spark, "tokens-chunks")
    stage = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda x: _stage(x, tokenizer, end_id, aside), "doc_id bigint, n_tokens bigint, digests array<binary>, lengths array<bigint>, file string, offsets array<bigint>")
    stage = written(spark, stage, "tokens-stage")
    # One place of each chunk is kept. Only places are shuffled; the chunks themselves go from file to file.
    places = stage.select("file", F.explode(F.arrays_zip("digests", "lengths", "offsets")).alias("c")).filter("c.offsets IS NOT NULL")
    places = places.groupBy(F.col("c.digests").alias("digest")).agg(F.min(F.struct("file", F.col("c.offsets").alias("offset"), F.col("c.lengths").alias("length"))).alias("at"))
    places = places.select("digest", "at.*").repartition(partitions(spark), "file").sortWithinPartitions("file", "offset")
    store = {"path": path, "width": width}
    _commit(path, "packs", places.mapInArrow(StoreWriter({**store, "table": "packs", "chunks": aside}).write, FILES).collect())
    discard(spark, aside)
    order = [F.col("doc_id"), F.col("digests")]
    recipes = ranged(spark, stage.select("doc_id", "n_tokens", "digests", "lengths"), [F.col("doc_id")], "tokens-recipes")
    recipes = running_sums(recipes, order, {"start": F.col("n_tokens")}, before=True)
    recipes = recipes.sortWithinPartitions("pid", *order)
    _commit(path, "recipes", recipes.mapInArrow(StoreWriter({**store, "table": "recipes"}).write, FILES).collect())


def _load(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    reader = StoreReader({"path": path, "table": table})
    files = reader.files()
    rows = [(f["number"], f["name"], f["width"], f["sha256"]) for f in files]
    return spark.createDataFrame(rows, FILES).repartition(max(1, len(files))).mapInArrow(reader.read_all, schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone, for each document: doc_id, start, n_tokens, ids_crc32."""
    pool, recipes = _load(spark, path, "packs", POOL_SCHEMA), _load(spark, path, "recipes", RECIPE_SCHEMA)
    pieces = recipes.select("doc_id", "start", "n_tokens", F.explode(F.arrays_zip("digests", "lengths", "ends")).alias("c"))
    after = F.greatest(F.col("n_tokens") - F.col("c.ends"), F.lit(0)) * 4  # bytes behind the chunk
    pieces = pieces.select("doc_id", "start", "n_tokens", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("length"), after.alias("after"))
    # What files hold is unknown to Spark's planner, which would take the packs for small and broadcast them.
    pieces = pieces.join(pool.hint("merge"), "digest", "left")
    pieces = pieces.withColumn("crc", F.when(F.col("n_ids") == F.col("length"), F.col("crc")).otherwise(F.raise_error(F.lit("a recipe names a chunk that the packs do not have")).cast("long")))
    sums = pieces.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor(F.pandas_udf(_shifted, "bigint")("crc", "after")).alias("ids_crc32"), F.sum("length").alias("held"))
    return sums.select("doc_id", "start", F.when(F.col("held") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe lacks ids")).cast("long")).alias("n_tokens"), "ids_crc32")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_and_verify(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    path = work_path(spark, "tokens")
    write_store(spark, docs, path, tokenizer or tokenizer_path(), end_id)
    return read_store(spark, path)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_verify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

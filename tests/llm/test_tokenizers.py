"""Byte-level BPE and the alignment of two tokenizers against the libraries and brute force."""

import base64
import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assaylake.llm import alignment, bytebpe
from tests.llm.test_llm import DATA, by_id, needs_data, odd  # noqa: F401

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as x:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzzed(n, seed):
    drawn = random.Random(seed)
    letters = [*map(chr, range(0x20)), *"  ..,,'!?-" * 3, *"abcdeXYZ012" * 4, *"\x7f\x80\xa0éßñΣжщ한漢字😀👍🏽‍́﻿▁\U000e0041", "<|endoftext|>", "<s>", "<0x41>", "'s", "'re", "the", " of", "    ", "\r\n", "aaaa"]
    return ["".join(drawn.choices(letters, k=drawn.randrange(0, 25))) for _ in range(n)]


# --- byte-level BPE


def test_the_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 100, 5000):
        hashes = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        table = bytebpe.PerfectHash(hashes)
        assert sorted(table.slots(hashes).tolist()) == list(range(len(hashes)))
        other = rng.integers(0, 2**63, 100).astype(np.uint64)
        assert ((table.slots(other) >= 0) & (table.slots(other) < len(hashes))).all()


def test_ids_of_fuzzed_texts(library):
    own = bytebpe.vocabulary(RANKS, PATTERN)
    texts = [*fuzzed(5000, 1), "", "a" * 50_000, " " * 3000 + "x", "漢字" * 2000, "\n" * 999]
    got = []
    for lo in range(0, len(texts), 100):
        ids, counts = own.encode(texts[lo : lo + 100])
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [t[:50] for t, x in zip(texts, got, strict=True) if x != library.encode_ordinary(t)] == []


def test_every_code_point_is_cut_as_the_library_does(library):
    own = bytebpe.vocabulary(RANKS, PATTERN)
    for lo in range(0, 0x110000, 1 << 14):
        texts = [f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(lo, lo + (1 << 14)) if not 0xD800 <= c < 0xE000]
        if not texts:
            continue
        text = "\n".join(texts)
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def _digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@needs_data
def test_bytebpe_query_against_the_library(spark, library):
    want = {r.doc_id: _digests(library, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id: tuple(r)[1:] for r in bytebpe.op11_bytebpe(spark, DATA).collect()} == want


def test_bytebpe_on_odd_rows(spark, odd, library, monkeypatch):  # noqa: F811
    odd = odd.unionByName(spark.createDataFrame([(None, "no id"), (9, "<|endoftext|> is text")], "doc_id bigint, text string"), allowMissingColumns=True).withColumn("ids", F.lit(1)).withColumn("bytes", F.lit(2))
    found = bytebpe.decode(bytebpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN).collect()
    want = sorted((str(r.doc_id), library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids, bytes(r.bytes)) for r in found) == want
    empty = bytebpe.encode(odd.limit(0), RANKS, PATTERN)
    assert bytebpe.decode(empty, RANKS, PATTERN).count() == 0


def test_long_documents_are_decoded_alone(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bytebpe, "GROUP", 7)
    texts = ["one two three four five six seven eight nine", "", "ten", "x", "one two three four five six seven eight nine"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([library.encode_ordinary(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    out = list(bytebpe._decode(iter([batch, batch.slice(2)]), RANKS, PATTERN))
    assert [x.decode() for b in out for x in b.column(2).to_pylist()] == [*texts, *texts[2:]] and len(out) > 3


# --- alignment


def slow(rows):
    """Groups, links, counts and digests by plain loops."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, byte = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), alignment._byte_level()
    a.encode_special_tokens = True
    spelt_b = lambda k: bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    docs, count = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        sides = []
        for ids, spelt in ((a.encode(f" {text}", add_special_tokens=False).ids, lambda k: bytes(byte[c] for c in a.id_to_token(k))), (b.encode(text), spelt_b)):
            parts = [spelt(k) for k in ids]
            sides.append((ids, list(itertools.accumulate(map(len, parts))), b"".join(parts)))
        if not text or any(s[2] != f" {text}".encode() for s in sides):
            docs.append((doc_id, [], [], []))
            continue
        (ids_a, at_a, _), (ids_b, at_b, _) = sides
        groups, i, j = [], 0, 0
        for end in sorted(set(at_a) & set(at_b)):
            m, n = at_a.index(end, i) + 1, at_b.index(end, j) + 1
            groups.append((ids_a[i:m], ids_b[j:n]))
            i, j = m, n
        links = [(x, y) for p, q in groups for x in p for y in q]
        count.update(set(links))
        docs.append((doc_id, ids_a, ids_b, groups))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, ids_a, ids_b, groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        digest = hashlib.sha256(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), digest))
    return out


def test_union_find_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, m = int(rng.integers(1, 40)), int(rng.integers(0, 60))
        u, v = rng.integers(0, n, (2, m))
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(u, v, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert alignment.united(n, u, v).tolist() == want


@pytest.mark.parametrize("few", [alignment.FEW, 0, 40])
def test_alignment_of_fuzzed_texts(spark, few, monkeypatch):
    monkeypatch.setattr(alignment, "MANY", 3)
    assert alignment.tokenizers(A, B).by_words
    rows = [(k, t) for k, t in enumerate(fuzzed(600, 3))] + [(None, "no id"), (7, "again"), (7, "again"), (8, None), (9, "▁"), (10, "a" * 2000), (11, " " * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit(0)).withColumn("pairs", F.lit(1)).repartition(3)
    got = [tuple(r) for r in alignment.align(spark, df, A, B, few).collect()]
    assert sorted(map(str, got)) == sorted(map(str, slow(rows)))


@needs_data
def test_alignment_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = [tuple(r) for r in alignment.op13_alignment(spark, DATA).collect()]
    assert sorted(got) == sorted(slow(rows))


def test_groups_and_empty_tables(spark, odd):  # noqa: F811
    got = by_id(alignment.groups(odd, A, B))
    assert got[2].a_ids == got[2].a_stops == [] and got[1].a_stops[-1] == len(got[1].a_ids) and len(got[1].a_stops) == len(got[1].b_stops)
    assert alignment.align(spark, odd.limit(0), A, B).count() == 0
    assert alignment.align(spark, odd, A, B).count() == odd.count()

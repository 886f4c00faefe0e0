"""Recall and precision that a constant answer fails, and links against brute force on thousands of documents."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import langid, learn, minhash, quality, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@needs_data
def test_both_classes_are_found(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    shares = {}
    for name, column, query, parts, which in (("toxic", "toxic", toxicity.op4_toxicity, 3, 1), ("quality", "quality", quality.op10_quality, 4, 2)):
        rows = [r for r in query(spark, DATA).collect() if r.doc_id in labels and labels[r.doc_id][column] is not None]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == which) and r.predicted == int(r.score >= 0.7) for r in rows)
        held = [(labels[r.doc_id][column], r.predicted, r.score) for r in rows if r.held_out]
        for k in (0, 1):
            own = [p == k for y, p, _ in held if y == k]
            assert len(own) > 5
            shares[name, k] = np.mean(own)
        # A score ranks the classes: how often one of class 1 is above one of class 0.
        ones, zeros = (np.array([s for y, _, s in held if y == k]) for k in (1, 0))
        shares[name, "rank"] = ((ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2).item()
    assert shares["toxic", 1] >= 0.75 and shares["toxic", 0] >= 0.97 and shares["toxic", "rank"] > 0.9
    assert shares["quality", 1] >= 0.9 and shares["quality", 0] >= 0.9 and shares["quality", "rank"] > 0.95


@needs_data
def test_every_language_is_found(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [(langs[r.doc_id], r.lang_pred) for r in langid.op2_langid(spark, DATA).collect() if r.held_out and langs[r.doc_id]]
    for lang, n in Counter(a for a, _ in rows).items():
        if n >= 10:
            assert np.mean([b == lang for a, b in rows if a == lang]) > 0.9, lang
            assert np.mean([a == lang for a, b in rows if b == lang]) > 0.9, lang


def test_many_languages_share_the_sample(spark, monkeypatch):
    """With few code points for many languages, each keeps its share; with very many documents, the smallest hashes count."""
    monkeypatch.setattr(learn, "CHARS", 5000)
    rows = [(100 * k + j, f"w{k}x{chr(97 + k % 26)}{chr(97 + k // 26)} " * 12, f"l{k:02}") for k in range(41) for j in range(30)] + [(9000, "long " * 2000, "l99")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == [*(f"l{k:02}" for k in range(41)), "l99"]
    assert sum(np.ptp(model.table[:, k]) > 0 for k in range(41)) == 41


def linked(rows, width, percent):
    """Links of distinct sets over shared shingles, and components by the smallest id."""
    sets, held = {}, defaultdict(list)
    for d, t in rows:
        w = t.lower().split()
        sets[d] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))
        for s in sets[d]:
            held[s].append(d)
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    n = 0
    for d in sorted(sets):
        both = Counter(o for s in sets[d] for o in held[s] if o < d)
        for o, shared in both.items():
            if 100 * shared >= percent * (len(sets[d]) + len(sets[o]) - shared):
                n += 1
                x, y = sorted((find(d), find(o)))
                top[y] = x
    return {d: find(d) for d in sets}, n


def near_threshold(seed, families, members, words):
    """Families whose members differ in about as many words as leaves a similarity near 0.8."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(families):
        base = [f"f{f}w{k}" if rng.random() < 0.8 else f"common{rng.integers(30)}" for k in range(int(rng.integers(*words)))]
        for _ in range(members):
            text = list(base)
            for k in rng.choice(len(text), int(rng.integers(1, max(2, len(text) // 22))), replace=False):
                text[k] = f"n{rng.integers(10**9)}"
            rows.append((len(rows) + 1, " ".join(text[: len(text) - int(rng.integers(0, 4))])))
    return rows


def test_links_near_the_threshold(spark):
    rows = near_threshold(11, 500, 6, (40, 160))
    want, n = linked(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()}
    assert n > 1000 and len(set(want.values())) > 600
    wrong = [d for d in want if got[d] != want[d]]
    assert len(wrong) <= 0.001 * len(rows), (len(wrong), n)


@pytest.mark.parametrize("block", [minhash.BLOCK, 8])
def test_a_family_larger_than_a_block(spark, monkeypatch, block):
    """Keys that stay open, in several blocks and bands of sizes."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_threshold(12, 3, 120, (60, 61))
    long = near_threshold(13, 1, 60, (300, 301))
    rows += [(1000 + d, " ".join(t.split()[: 300 - 3 * (d % 40)])) for d, t in long]  # of many sizes
    want, _ = linked(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark, spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("x", F.lit(1)), 4).collect()}
    assert got == want

"""Odd rows: nulls, repeats, empty tables, clashing columns, control characters, texts with very many matches."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import decontam, fingerprint, minhash, mixing, secrets, tokens, toxicity, warc
from assaylake.llm.common import work_path
from tests.llm.test_llm import base_spans, by_id

#: Names that operators use, or used, for columns of their own.
CLASHING = "_copies _before _node _words _more _copy _source _size _key _own _stay _id _text row key size regions before copies node more text_ component".split()


def stored(tmp_path, df, name="documents"):
    df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


def with_clashes(df):
    for k, name in enumerate(CLASHING):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(k))
    return df


# --- secrets


def test_very_many_matches_take_linear_time(spark):
    texts = [" ".join(f"token=abcdefg{k % 10}é" for k in range(n)) for n in (1, 2, 3, 7, 8, 9, 1000, 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.time()
    got = by_id(secrets.scan(spark, df, work_path(spark, "t"), rules=secrets.BASE).select("doc_id", secrets.joined(F.col("found")).alias("s")))
    assert time.time() - began < 60
    assert {k: r.s for k, r in got.items()} == {k: base_spans(t) for k, t in enumerate(texts)}


def test_secrets_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert secrets.scan(spark, empty, work_path(spark, "t")).count() == 0


# --- tokens


def test_ids_of_fuzzed_texts_are_the_library_s():
    from tokenizers import Tokenizer

    drawn, model, own = random.Random(5), Tokenizer.from_file(tokens.tokenizer_path()), tokens.Encoder(tokens.tokenizer_path())
    letters = [*map(chr, range(0x20)), *"  ..,,'!?-" * 3, *"abcdeXYZ012" * 4, *"\x7f\x80\x85\xa0\xad\xb5\xaa\xba\xc9\xdf\xe9\xff", *"ıİſΣς 　́﻿漢😀", "<|endoftext|>", "'s", "'re", ". ", ", ", ".\n"]
    texts = ["".join(drawn.choices(letters, k=drawn.randrange(1, 14))) for _ in range(20_000)]
    want = [np.array(x.ids, own.kind).tobytes() for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    got = list(itertools.chain.from_iterable(own.encode(texts[k : k + 50]) for k in range(0, len(texts), 50)))
    assert [t for t, a, b in zip(texts, want, got, strict=True) if a != b] == []


def test_another_vocabulary_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  World, it IS\x1c. so\n\n", "", "UPPER lower. ok"]
    assert tokens.Encoder(path).encode(texts) == [np.array(x.ids, "<u2").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_tokens_of_an_empty_table(spark):
    assert tokens.encode_and_verify(spark, spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# --- fingerprints


def test_fingerprints_of_texts_as_long_as_a_shingle(spark, tmp_path):
    texts = ["a b c d" + " " * 16, "e f g h" + " " * 16, "a b c d e", "a b c d e" + " " * 20, "a", "", None, " ", "a b c d e f g h i j k l m n o p"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got, plain = by_id(fingerprint.op6_fingerprint(spark, stored(tmp_path, df))), by_id(fingerprint.fingerprints(df))
    assert {k: r.fingerprint for k, r in got.items()} == {k: r.fingerprint for k, r in plain.items()}
    assert got[0].fingerprint != got[1].fingerprint and all(len(got[k].fingerprint) == 2 * fingerprint.BINS for k in (0, 1, 2, 3, 4))
    edited = {k: (t or "")[: len(t or "") - len(t or "") // 4] + (texts[(k + 1) % len(texts)] or "")[: len(t or "") // 4] for k, t in enumerate(texts)}
    assert {k: r.edited_sha256 for k, r in got.items()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in edited.items()}
    again = by_id(fingerprint.fingerprints(spark.createDataFrame(list(edited.items()), "doc_id bigint, text string")))
    assert {k: r.edited_fingerprint for k, r in got.items()} == {k: r.fingerprint for k, r in again.items()}


def test_fingerprints_of_repeated_and_missing_ids(spark, tmp_path):
    rows = [(None, "x y z"), (3, "one two three four five six seven"), (3, "other text of the same id here"), (5, None)]
    got = fingerprint.op6_fingerprint(spark, stored(tmp_path, spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((d is None, d or 0, len(t or "")) for d, t in rows)


@pytest.mark.parametrize("rows", [[], [(7, "alone with itself and no other text")]])
def test_fingerprints_of_few_rows(spark, tmp_path, rows):
    got = fingerprint.op6_fingerprint(spark, stored(tmp_path, spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert len(got) == len(rows) and all(r.near_next == 1.0 for r in got)


# --- archives


def test_pages_without_an_id_and_with_repeated_ids(spark, tmp_path):
    same, lone = "<p>" + "x" * 1200, "<q>" + "y" * 1200
    rows = [(None, "u", same), (3, "u", same), (9, "u", same), (9, "v", same), (None, "u", lone), (None, "u", lone), (None, None, None), (4, "u", "short")]
    got = warc.op8_warc(spark, stored(tmp_path, spark.createDataFrame(rows, "page_id bigint, url string, html string"), "pages")).collect()
    want = []
    for d, _, html in rows:
        body, again = (html or "").encode(), html == same and d != 9
        want.append((d, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_malformed_foreign_records(spark, tmp_path):
    good = warc.record_bytes("urn:x", "response", "http://x", "00", 3, None, b"abc", "2020-01-01T00:00:00Z")
    bare = b"WARC/1.0\r\nWARC-Type: metadata\r\n\r\n\r\n\r\n"  # no length
    (tmp_path / "a.warc").write_bytes(good + bare + good + b"rubbish without an end")
    warc.register(spark)
    got = spark.read.format(warc.FORMAT).load(f"file://{tmp_path}").collect()
    assert [(r.record_type, bytes(r.payload)) for r in got] == [("response", b"abc"), ("metadata", b""), ("response", b"abc")]


# --- mixing


def test_documents_without_an_id_are_drawn(spark):
    rows = [(None, "a", " ".join(["w"] * 50) + f" {k}") for k in range(40)] + [(k, "b", "w " * 100) for k in range(20)] + [(500, "c", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mixing.mix(spark, docs).toPandas()
    for name, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 100, name
    assert got[got.source == "a"].taken.gt(0).sum() not in (0, 40)
    assert mixing.mixed(spark, docs).filter("source = 'a'").count() == got[got.source == "a"].copies.sum()


def test_the_salted_join_mixes_alike(spark, monkeypatch):
    rows = [(k, None if k % 41 == 0 else f"s{k % 40}", "w " * (k % 17)) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    want = sorted(map(str, mixing.mix(spark, docs).collect()))
    monkeypatch.setattr(mixing, "FEW", 3)
    assert sorted(map(str, mixing.mix(spark, docs).collect())) == want


# --- the pipeline


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(60))
    passage = "a passage of the benchmark that is long enough to be found"
    rows = [(1, text, "a"), (2, text + " more", "a"), (2, text + " more", "a"), (3, None, None), (4, f"so {passage} it is", "b"), (None, "no id " + text, "b"), (5, "", "b"), (6, " ".join(f"v{k}" for k in range(50)), "b")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    marks = {name: k for k, name in enumerate(CLASHING)}
    out = docs
    for (name, stage), stays in zip(corpus_pipeline.STAGES, ([1, 2, 2, 3, 4, 5, 6, None], [1, 3, 4, 5, 6, None], [1, 3, 5, 6, None], None, None), strict=True):
        out = stage(spark, out, f"file://{tmp_path}")
        kept = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns and all(r[c] == k for r in kept for c, k in marks.items()), name
        if stays is not None:
            assert sorted(((r.doc_id is None, r.doc_id) for r in kept), key=str) == sorted(((d is None, d) for d in stays), key=str), name
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, f"file://{tmp_path}")
        assert empty.count() == 0


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(1, "bad"), (2, "good")], "doc_id bigint, text string")
    once = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    many = spark.createDataFrame([(1, 1)] * 30 + [(2, 0)], "doc_id bigint, toxic int")
    score = lambda labels: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.scores(docs, toxicity.fit(docs, labels)).collect())
    assert score(once) == score(many)
    assert toxicity.clean(docs.limit(0), toxicity.fit(docs, once)).count() == 0


def test_regions_replace_a_column_and_clean_keeps_it(spark):
    docs = spark.createDataFrame([(1, "forty two", "own"), (2, "none", "own")], "doc_id bigint, text string, regions string")
    bench = spark.createDataFrame([(1, "forty two")], "item_id bigint, text string")
    assert [len(r.regions) for r in decontam.regions(spark, docs, bench).orderBy("doc_id").collect()] == [1, 0]
    assert [tuple(r) for r in decontam.clean(spark, docs, bench).collect()] == [(2, "none", "own")]


def test_groups_of_an_empty_table(spark):
    assert minhash.one_of_each(spark, spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert re.fullmatch("[0-9]+", str(minhash.near_groups(spark, spark.createDataFrame([], "doc_id bigint, text string")).count()))

import os

import pytest
from pyspark.sql import functions as F

from skeinwork.llm import tokens

PATH = f"{tokens.VOCABULARIES}/{tokens.BYTE_BPE}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")

TEXTS = [
    None, "", " ", "\n\n  x \t y z  ", "it's we'll 'tis ''s", "before<|endoftext|>after", "Grüße, l'été — ¿qué?", "温度 23℃ と 湿度", "a" * 5000, "é" * 3000, "x\u0085᠎​y",
    "line\r\nline\r\n", "\U0001f680 go \U0001f469‍\U0001f52c", "͸ unassigned", "١٢٣ 12٣ ½", "é combining", "\x00\x01 \x1c\x1f", "word " * 20_000, "   lead", "trail   ", "﻿bom",
]


def test_ids_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("block", F.lit(1)).withColumn("words", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    t = tokens.tokenizer(PATH)
    for i, text in enumerate(TEXTS):
        assert got[i] == t.encode(text or "", add_special_tokens=False).ids, repr(text)[:60]
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id, len(r.ids)) for r in tokens.encode(df).collect()) == [(1, 2), (1, 2), (2, 0)]
    assert tokens.encode(df.limit(0)).count() == 0
    assert tokens.decode(tokens.encode(df.where("text is null"))).first().text == ""


def test_each_distinct_word_is_encoded_once(spark):
    df = spark.createDataFrame([(i, "same words again") for i in range(50)], "doc_id bigint, text string")
    table = {r.word: (r.occurrences, r.ids) for r in tokens.word_table(df).collect()}
    assert {w: n for w, (n, _) in table.items()} == {"same": 50, " words": 50, " again": 50}


def test_whole_corpus_against_the_tokenizer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokens.encode(docs).collect()}
    t = tokens.tokenizer(PATH)
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == t.encode(r.text or "", add_special_tokens=False).ids


def test_blocks_grow_in_number_with_the_bytes_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_BYTES", 20_000)
    monkeypatch.setattr(tokens, "LEAST_BYTES", 1_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for docs in (500, 4_000):
            df = spark.range(docs).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ten bytes "), 20).alias("text"))
            blocks = tokens._blocked(df, "doc_id", "text").groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()
            assert sum(r.n for r in blocks) == docs
            assert len(blocks) >= docs * 200 / 20_000 * 0.9 and max(r.n for r in blocks) * 200 <= 2 * 20_000
            assert {len(r.ids) for r in tokens.encode(df).collect()} == {len(tokens.tokenizer(PATH).encode("ten bytes " * 20, add_special_tokens=False).ids)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_out_of_the_vocabulary_and_null_lists(spark):
    df = spark.createDataFrame([(1, [10_000_000]), (2, None), (3, []), (3, [])], "doc_id bigint, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in tokens.decode(df).collect()) == [(1, "\ufffd"), (2, ""), (3, ""), (3, "")]

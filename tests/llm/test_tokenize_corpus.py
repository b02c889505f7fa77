import random

import pytest
from pyspark.sql import functions as F

from mergewell.llm.tokenize_corpus import BacktrackingEncoder, encode_texts, encoder_of, read_ranks, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(vocabulary_path(), "rb") as f:
        return encoder_of(f.read())


def test_random_token_strings(encoder, reference):
    r = random.Random(1)
    texts = list(encoder.text.values())
    for _ in range(3000):
        s = "".join(r.choice(texts) for _ in range(r.randint(1, 6))).encode("latin-1").decode("utf-8", "ignore")
        assert encoder.encode(s) == reference(s)


def test_odd_texts(encoder, reference):
    for s in ("<|endoftext|>", "a<|endoftext|>b", "   ", "\n\n \t x", "a" * 3000, "ab" * 999, "éé漢字🙂👍🏽", "don't I'LL we've", "1234567 ½²", "​﻿", "Ünïcödé ẞ"):
        assert encoder.encode(s) == reference(s), s


def test_decoding_gives_the_text_back(encoder):
    s = "Any text, 漢字 too.\n\n  End"
    assert "".join(encoder.text[i] for i in encoder.encode(s)).encode("latin-1").decode() == s


def test_other_vocabulary():
    import base64  # noqa: F401

    import tiktoken

    with open(vocabulary_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = read_ranks(f.read())
    from mergewell.llm.tokenize_corpus import PIECES

    own, other = BacktrackingEncoder(ranks), tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    for s in ("Über den Wäldern", "Многие дешёвые", "hello world's", "東京 タワー"):
        assert own.encode(s) == other.encode_ordinary(s)


def test_table(spark, reference):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, " "), (1, "Hello world"), (None, "x"), (5, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("_text", F.lit("clash"))
    got = encode_texts(df).collect()
    assert len(got) == len(rows) and [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    assert [r.ids for r in got if r.doc_id == 1] == [reference("Hello world")] * 2 and [r.ids for r in got if r.doc_id == 4] == [reference(" ")]
    assert next(r.ids for r in got if r.doc_id == 5) == reference("word " * 200_000)
    assert encode_texts(df.limit(0)).count() == 0
    assert dict(encode_texts(df).dtypes)["ids"] == "array<int>"


def test_corpus(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in encode_texts(docs).collect():
        assert list(r.ids) == reference(text[r.doc_id] or "")

"""Encoding against the tiktoken library, decoding against the text."""

import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T

from docweave.llm import bpe

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.coder(f.read()).ranks
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(7)
    out = [None, "", " ", "\x1c\x1d a\x85b  x​", "a" * 4000, "日本語テキスト🤷🏽‍♀️" * 20, "=" * 999 + "\n\n\t x", "<|endoftext|>"]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(1, 0x300), rnd.randrange(0x4E00, 0x9FFF)])) for _ in range(rnd.randrange(60))) for _ in range(400)]
    return out + ["".join(rnd.choice(["the", "an", "er", "ción", "ß", "ung", "'ll", " "]) for _ in range(rnd.randrange(40))) for _ in range(400)]


def test_ids_are_those_of_the_library(spark, library):
    given = texts()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("IDS", T.StringType())])
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], schema)
    rows = bpe.encode_decode(df, VOCABULARY, P.PATTERN, outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(rows) == len(given)
    for r in rows:
        want = library.encode_ordinary(given[r.doc_id] or "")
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert bytes(r.decoded).decode() == (given[r.doc_id] or "")
        assert r.decoded_sha256 == hashlib.sha256((given[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(df, VOCABULARY, P.PATTERN).collect() == []


def test_vocabulary_without_bytes():
    with pytest.raises(ValueError):
        bpe.Coder({b"a": 0})

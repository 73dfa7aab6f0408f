"""Ids and decoded texts against the sentencepiece library."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import pieces

MODEL = P.path("piece_bpe_32k.model")
ALL = tuple(pieces.OUTPUTS)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    with open(MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def test_ids_are_those_of_the_library(spark, library):
    rnd = random.Random(7)
    given = [None, "", " ", "   ", " a", "a  ", "a▁b", "▁", "<s> </s> <unk> <0x0A>", "\n\n\tx\r", "\x00\x01", "日本語テキスト🤷🏽‍♀️" * 20, "�", "é", "=" * 999, "abab" * 30_000, "word " * 20_000]
    given += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(1, 0x300), rnd.randrange(0x4E00, 0x9FFF), 0x2581])) for _ in range(rnd.randrange(60))) for _ in range(400)]
    given += ["".join(rnd.choice(["the", "an", "er", "ción", "ß", "ung", "'ll", " ", "  "]) for _ in range(rnd.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], "doc_id long, text string, IDS string")
    rows = pieces.encode_decode(df, MODEL, outputs=ALL).collect()
    assert len(rows) == len(given)
    for r in rows:
        want = library.encode(given[r.doc_id] or "")
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded == library.decode(want) and r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_agenda_over_whole_texts(own, library, text):
    marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    assert own.encode(marked) == library.encode(text)


def test_ties_go_left(own, library):
    for text in ("aaaaaaa", "nnnnnnnn", "....,,,,....", "ssssssssssss" * 7, "1111111", "eeeeeee eeee"):
        assert own.encode(pieces.MARK + text.replace(" ", pieces.MARK)) == library.encode(text)


def test_a_difference_is_an_error(own):
    class Other:
        def piece_to_id(self, piece):
            return 0

        def encode(self, words, num_threads):
            return [[5] for _ in words]

    with pytest.raises(ValueError):
        pieces.Memo(own, Other()).learn(["▁ab"])


def test_long_words_are_not_remembered(own):
    memo = pieces.Memo(own, None)
    assert memo.learn(["▁" + "ab" * 60, "▁a"]) == ["▁" + "ab" * 60]


def test_other_models_are_refused():
    with open(MODEL, "rb") as f:
        model = f.read()
    at = model.rindex(b"identity") - 2
    with pytest.raises(ValueError):
        pieces.Pieces(model[: at - 2] + b"\x1a\x04" + b"\x18\x00\x20\x00")


def test_empty_table(spark):
    assert pieces.encode_decode(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def test_words_come_back_from_the_old_half(own, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 4)
    memo, made = pieces.Memo(own, None), []
    monkeypatch.setattr(own, "encode", lambda w, f=own.encode: made.append(w) or f(w))
    for word in ("▁a", "▁b", "▁c", "▁a", "▁d", "▁a", "▁e", "▁a"):
        memo.learn([word])
        assert list(memo[word]) == list(bytes(memo[word])) and len(memo) <= 4
    assert made == ["▁a", "▁b", "▁c", "▁d", "▁e"]

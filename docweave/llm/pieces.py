"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised as the model says: a space before it, spaces as U+2581. Encoding merges adjacent symbols, the best
score first and the leftmost of equals, from an agenda: a heap of the pairs that make a piece of the vocabulary. Merging
a pair puts its two new neighbours on the agenda; entries whose symbols are gone are passed over. Symbols that are no
piece become the pieces of their bytes.

No piece of such a vocabulary holds a U+2581 after another character, so merges never cross from a word to the next; a
model in which some piece does is cut nowhere. Words that a task hasn't met are encoded once an Arrow batch and compared
with the sentencepiece library's ids of the same words; a difference is an error. Decoding goes by the ids alone.

Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated results, an empty table an
empty one. U+2581 in a text decodes to a space, as in the library. Very long texts, even of one word, take time in
proportion to their length times its logarithm. Columns of the result replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.blocks import add_columns

#: Distinct words that a worker remembers, some 230 bytes each, and the longest that it remembers.
MEMO, LONGEST = 1_000_000, 64
#: The mark that stands for a space.
MARK = "▁"
#: Bits of a symbol or place, and the symbol that a merge has taken up.
SHIFT, GONE = 40, -1
LOW = (1 << SHIFT) - 1
#: Words of up to so many characters keep their agenda as a list; the place of a pair that makes no piece.
SHORT, NEVER = 32, 1 << SHIFT

#: What an output column holds.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}

#: Fixed values of the model file: kinds of pieces, the merge type, and the numbers of fields.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3


def _fields(b: bytes) -> dict[int, list]:
    """Values of a protocol-buffer message by field number."""

    def number(i: int) -> tuple[int, int]:
        value, shift = 0, 0
        while True:
            value |= (b[i] & 127) << shift
            if b[i] < 128:
                return value, i + 1
            i, shift = i + 1, shift + 7

    found: dict[int, list] = {}
    i = 0
    while i < len(b):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            size, i = number(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = b[i : i + size], i + size
        found.setdefault(key >> 3, []).append(value)
    return found


class Pieces:
    """Encodes words by the pieces and scores of a model."""

    def __init__(self, model: bytes):
        whole = _fields(model)
        trainer, normalizer = _fields(whole[TRAINER][0]), _fields(whole[NORMALIZER][0])
        if trainer.get(3, [1])[0] != MERGES or not trainer.get(35, [0])[0]:
            raise ValueError("the model isn't of the merge type with byte pieces")
        if normalizer.get(2, [b""])[0] or not normalizer.get(3, [1])[0] or normalizer.get(4, [1])[0] or not normalizer.get(5, [1])[0] or trainer.get(24, [0])[0]:
            raise ValueError("the model normalises texts in another way than by marking spaces")
        scores: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.text: list[bytes] = []
        for i, piece in enumerate(map(_fields, whole[PIECES])):
            text, kind = piece[1][0].decode(), piece.get(3, [NORMAL])[0]
            if kind in (USER_DEFINED, UNUSED):
                raise ValueError("the model has pieces that users defined, or unused ones")
            if kind == NORMAL:
                scores[text], self.id[text] = struct.unpack("<f", piece[2][0])[0] if 2 in piece else 0.0, i
                self.text.append(text.replace(MARK, " ").encode())
            elif kind == BYTE:
                self.byte[int(text[3:5], 16)] = i
                self.text.append(bytes([int(text[3:5], 16)]))
            else:
                self.text.append(b"" if kind == CONTROL else " ⁇ ".encode())
        # Symbols are the numbers of pieces, then those of characters that occur within pieces only, or nowhere.
        self.unknown = len(self.text)
        self.symbol = dict(self.id)
        for k, c in enumerate(sorted({c for piece in self.id for c in piece} - set(self.id))):
            self.symbol[c] = self.unknown + 1 + k
        self.decimal = [str(i).encode() for i in range(self.unknown)]
        self.length = {i: len(piece) for piece, i in self.id.items()}
        place = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        # Two symbols, as one number -> the place of their piece among all scores, and the piece.
        self.place: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for piece, i in self.id.items():
            for k in range(1, len(piece)):
                left, right = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if left is not None and right is not None:
                    self.place[left << SHIFT | right], self.made[left << SHIFT | right] = place[scores[piece]], i
        crossing = any(regex.search(f"[^{MARK}]{MARK}", piece) for piece in self.id)
        self.words = (lambda text: [text] if text else []) if crossing else regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def encode(self, word: str) -> list[int]:
        """Ids of a word, whose spaces are marked."""
        unknown, symbol = self.unknown, self.symbol.get
        symbols = [symbol(c, unknown) for c in word]
        symbols = (self._merged_short if len(symbols) <= SHORT else self._merged_long)(symbols)
        if max(symbols, default=0) < unknown:
            return symbols
        at, ids = 0, []
        for s in symbols:
            if s < unknown:
                at += self.length[s]
                ids.append(s)
            else:
                ids += [self.byte[b] for b in word[at].encode()]
                at += 1
        return ids

    def _merged_short(self, symbols: list[int]) -> list[int]:
        """The agenda is the list of places of all adjacent pairs, in the order of the text; the least, and the first of it, is taken."""
        place = self.place.get
        agenda = [place(a << SHIFT | b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            new = symbols[i] = self.made[symbols[i] << SHIFT | symbols.pop(i + 1)]
            del agenda[i]
            if i:
                agenda[i - 1] = place(symbols[i - 1] << SHIFT | new, NEVER)
            if i < len(agenda):
                agenda[i] = place(new << SHIFT | symbols[i + 1], NEVER)
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The agenda is a heap; an entry is the place of a pair and that of its left symbol. Entries whose symbols are gone are passed over."""
        place, push, pop = self.place.get, heapq.heappush, heapq.heappop
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        agenda = [p << SHIFT | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (p := place(a << SHIFT | b)) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = pop(agenda)
            i = entry & LOW
            j = after[i]
            if j >= n or symbols[i] == GONE or place(pair := symbols[i] << SHIFT | symbols[j]) != entry >> SHIFT:
                continue
            new = symbols[i] = self.made[pair]
            symbols[j] = GONE
            after[i] = k = after[j]
            before[k] = i
            if k < n and (p := place(new << SHIFT | symbols[k])) is not None:
                push(agenda, p << SHIFT | i)
            k = before[i]
            if k >= 0 and (p := place(symbols[k] << SHIFT | new)) is not None:
                push(agenda, p << SHIFT | k)
        return [s for s in symbols if s != GONE]

    def decode(self, ids) -> bytes:
        """Bytes of the ids' pieces, the space before a text included."""
        return b"".join(map(self.text.__getitem__, ids))


class Memo(dict):
    """Word -> its ids, packed as 32-bit integers. When half of MEMO is full, it becomes the old half: words met again move over, others go with the next change."""

    def __init__(self, pieces: Pieces, library: sentencepiece.SentencePieceProcessor | None):
        super().__init__()
        self.pieces, self.library, self.old = pieces, library, {}

    def _by_library(self, words: list[str]) -> list[list[int]]:
        """The library's ids; only for an empty text does it put no mark."""
        ids = self.library.encode([w[1:].replace(MARK, " ") for w in words], num_threads=1) if words else []
        return [x or [self.library.piece_to_id(MARK)] for x in ids]

    def learn(self, words: list[str]) -> list[str]:
        """Encode the words that aren't known yet, compare them with the library's, and return those too long to remember. Each word begins with a mark, which the library puts there itself."""
        if len(self) > MEMO // 2:
            self.old = dict(self)
            self.clear()
        unmet = set(words).difference(self)
        again = unmet & self.old.keys()
        self.update((w, self.old[w]) for w in again)
        new = list(unmet - again)
        ids = list(map(self.pieces.encode, new))
        if self.library is not None and self._by_library(new) != ids:
            raise ValueError("the agenda and the sentencepiece library give different ids")
        self.update(zip(new, [array("i", x).tobytes() for x in ids]))
        return [w for w in new if len(w) > LONGEST]


@lru_cache(maxsize=2)
def memo_of(model: bytes, check: bool = True) -> Memo:
    """One memo for all tasks of a worker."""
    return Memo(Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model) if check else None)


def encode_decode(docs: DataFrame, model: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids",), check: bool = True) -> DataFrame:
    """`docs` with the asked-for OUTPUTS of each text.

    model: path of a sentencepiece model on the driver; it goes to the executors as a broadcast of its fixed size (half a
    megabyte for 32,000 pieces). check: whether new words are compared with the library's ids.
    """
    with open(model, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    added, asked = T.StructType([T.StructField(c, OUTPUTS[c]) for c in outputs]), set(outputs)

    def make():
        memo = memo_of(proto.value, check)
        own = memo.pieces

        def work(texts: pa.Array) -> dict:
            made: dict = {c: [] for c in outputs}
            split = [own.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts.to_pylist()]
            long = memo.learn([w for words in split for w in words])
            for words in split:
                packed = np.frombuffer(b"".join(map(memo.__getitem__, words)), np.int32)
                ids = packed.tolist()
                if "n_tokens" in asked:
                    made["n_tokens"].append(len(ids))
                if "ids" in asked:
                    made["ids"].append(packed)
                if "ids_sha256" in asked:
                    made["ids_sha256"].append(hashlib.sha256(b",".join(map(own.decimal.__getitem__, ids))).hexdigest())
                if asked & {"decoded", "decoded_sha256"}:
                    back = own.decode(ids).decode(errors="replace").removeprefix(" ")
                    if "decoded" in asked:
                        made["decoded"].append(back)
                    if "decoded_sha256" in asked:
                        made["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            for w in long:
                del memo[w]
            return made

        return work

    return add_columns(docs, text_col, make, added)

"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds every
token inside a piece. Encoding goes left to right: take the longest token at the position, go to shorter
prefixes while the token isn't compatible with its left neighbour, and step back where none fits. Two tokens
are compatible if the merges, run over their joined bytes, would leave just these two; that is decided by
undoing merges at the seam, and remembered for each pair. The result equals that of the merges.

Null and empty texts have no tokens. A vocabulary without all 256 single bytes is an error. Columns of the
result replace columns of the same name; all others are kept. Repeated rows give repeated results, an empty
table an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.blocks import add_columns

#: Distinct pieces that a task remembers before it starts afresh.
MEMO = 200_000

#: What an output column holds.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
}

#: White space of the Unicode standard, as fixed values.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(pattern: str) -> regex.Pattern:
    """The pattern, with white space as Unicode has it rather than Python."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


class Coder:
    """Encodes single pieces by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.above = max(ranks.values(), default=0) + 1
        self.shorter: dict[int, int | None] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        for i in sorted(self.text):
            b = self.text[i]
            self.shorter[i] = next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), None)
        for i in sorted(self.text):
            self._split(i)
        self.reachable = ahocorasick.Automaton()
        for i in self.halves:
            self.reachable.add_word(self.text[i].decode("latin-1"), i)
        self.reachable.make_automaton()
        self.fits.clear()

    def _split(self, i: int) -> None:
        """The two tokens whose merge makes token i, if any merge does."""
        b = self.text[i]
        if len(b) == 1:
            self.halves[i] = (i, i)
            return
        left = self.shorter[i]
        while left is not None:
            right = self.ranks.get(b[self.size[left] :])
            if left < i and right is not None and right < i and left in self.halves and right in self.halves and self.compatible(left, right, i):
                self.halves[i], self.joined[left, right] = (left, right), i
                return
            left = self.shorter[left]

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merges, all of them or those of rank under `below`, leave left and right apart when they stand side by side."""
        limit = self.above if below is None else below
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < limit:
                return False
            if left > right:  # the left token was made last: undo it first
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, before, right = right + 1, right, self.halves[right][0]
                    if right == before:
                        return True
            else:
                limit, before, right = right + 1, right, self.halves[right][0]
                if right == before:
                    limit, before, left = left, left, self.halves[left][1]
                    if left == before:
                        return True

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[int] = [0] * n
        size, shorter, fits = self.size, self.shorter, self.fits
        for end, i in self.reachable.iter(piece.decode("latin-1")):
            start = end - size[i] + 1
            if not longest[start] or size[i] > size[longest[start] - 1]:
                longest[start] = i + 1
        closed = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] - 1
        while True:
            end = at + size[token]
            good = not closed[end]
            if good and out:
                pair = (out[-1], token)
                good = fits.get(pair)
                if good is None:
                    if len(fits) > 4 * MEMO:
                        fits.clear()
                    good = fits[pair] = self.compatible(*pair)
            if good:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at] - 1
                continue
            less = shorter[token]
            while less is not None and less not in self.halves:
                less = shorter[less]
            if less is not None:
                token = less
            else:
                closed[at] = 1
                token = out.pop()
                at -= size[token]


class Memo(dict):
    """Piece -> its ids, packed as little-endian 32-bit integers."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        packed = np.array(self.coder.encode(piece.encode()), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def coder(lines: bytes) -> Coder:
    """From the lines of a rank file: base64 token, space, rank."""
    return Coder({base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines.splitlines() if x.strip())})


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """`docs` with the asked-for OUTPUTS of each text.

    vocabulary: path of a rank file on the driver; it goes to the executors as a broadcast of its fixed size
    (under a megabyte for 50,000 tokens). pattern: splits a text into pieces. "decoded" and its digest come
    from the ids, not from the text.
    """
    with open(vocabulary, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    added = T.StructType([T.StructField(c, OUTPUTS[c]) for c in outputs])

    def make():
        model = coder(lines.value)
        memo = Memo(model)
        pieces, token, asked = splitter(pattern).findall, model.text.__getitem__, set(outputs)

        def work(texts: pa.Array) -> dict:
            made: dict = {c: [] for c in outputs}
            for text in texts.to_pylist():
                packed = b"".join(map(memo.__getitem__, pieces(text or "")))
                if "n_tokens" in asked:
                    made["n_tokens"].append(len(packed) // 4)
                if "ids_sha256" in asked:
                    made["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                if asked - {"n_tokens", "ids_sha256"}:
                    ids = np.frombuffer(packed, "<u4")
                    if "ids" in asked:
                        made["ids"].append(ids.astype(np.int32))
                    if asked & {"decoded", "decoded_sha256"}:
                        back = b"".join(map(token, ids.tolist()))
                        if "decoded" in asked:
                            made["decoded"].append(back)
                        if "decoded_sha256" in asked:
                            made["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            return made

        return work

    return add_columns(docs, text_col, make, added)

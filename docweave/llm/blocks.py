"""Arrow and numpy helpers that the text operators share.

A task sees its rows as Arrow batches. `add_columns` cuts them into blocks of about a megabyte of text and
of 2,048 rows at most, so that the arrays derived from a block stay small however long a batch is and however
short its texts are; a text longer than that makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 2048

#: Word boundaries: space and bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after the other, and where each row's begin and end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes, and of `rows` rows at most."""
    _, at = raw(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = min(max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1), low + rows, n)
        yield low, high
        low = high


def add_columns(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], dict]], added: T.StructType, drop: tuple[str, ...] = (), limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS, whole: bool = False) -> DataFrame:
    """`df` with the columns of `added`, which replace any of the same name.

    make() is called once in each task and returns the function that maps a block of texts to
    {column: values}; with `whole` it is given all columns of the block. Rows stay where they are: no shuffle.
    """
    names = {f.name.lower() for f in added} | {c.lower() for c in drop}
    kept = [f for f in df.schema if f.name.lower() not in names]
    out = T.StructType([*kept, *added])
    arrow = to_arrow_schema(out)
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for low, high in blocks(texts, limit, rows):
                part = batch.slice(low, high - low)
                made = work(part if whole else texts.slice(low, high - low))
                old = [part.column(part.schema.get_field_index(c)).cast(arrow.field(c).type) for c in keep]
                new = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], arrow.field(f.name).type) for f in added]
                yield pa.RecordBatch.from_arrays(old + new, schema=arrow)

    return df.mapInArrow(run, out)


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words are runs of bytes that aren't white space."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = at[:-1][at[:-1] < n]
    first[edge] = word[edge]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = word[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at[1:], start, "right")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = {"of": np.ones(1, np.uint64)}


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, modulo 2**64."""
    if len(_POWER["of"]) < n:
        with np.errstate(over="ignore"):
            _POWER["of"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, 0x2545F4914F6CDD1D, np.uint64)]), dtype=np.uint64)
    return _POWER["of"]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, spans being in order and apart: a polynomial over scrambled bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    value = _BYTE[data[place + np.repeat(start, size)]]
    value *= _powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def shingles(word: np.ndarray, row: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the k-word windows; a row of fewer words has one shingle of all of them."""
    many = max(0, len(word) - k + 1)
    h = np.zeros(many, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[j : j + many]
    whole = row[: many] == row[k - 1 : k - 1 + many]
    h, r = mix(h[whole]), row[: many][whole]
    count = np.bincount(row, minlength=n_rows)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        short = []
        for i in few:
            s = np.uint64(count[i])
            with np.errstate(over="ignore"):
                for w in word[first[i] : first[i] + count[i]]:
                    s = s * np.uint64(0xC2B2AE3D27D4EB4F) + w
            short.append(s)
        h, r = np.concatenate([h, mix(np.array(short, np.uint64))]), np.concatenate([r, few])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r

"""Telephony audio columns.

A text's bytes become the samples of a telephone call: 8-bit mu-law at 8 kHz in a WAV file. Reading goes the
other way: the file is parsed, its samples are expanded by lookup tables (mu-law, and A-law for comparison),
the same bytes are decoded as ADPCM blocks (a step at a time, across all blocks at once), and the mu-law
samples are resampled to 16 kHz and stored as 16-bit PCM in a second WAV file.

Null and empty texts become one block of padding. A text ends where its bytes end, whatever they are; `n_bytes`
tells padding from text. Very long texts make one long call. Columns of the result replace columns of the same name; all others are kept.
Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.blocks import add_columns, raw

#: Payloads are padded with this byte to a positive multiple of this many bytes, which is also an ADPCM block.
PAD, BLOCK = 255, 576
RATE = 8000
PCM, MU_LAW = 1, 7

# Fixed values of IMA ADPCM: quantiser steps, and how a code moves the step index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411,
    1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mu_law_table() -> np.ndarray:
    """Sample of each mu-law byte, in 16 bits."""
    u = ~np.arange(256, dtype=np.int32) & 255
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """Sample of each A-law byte, in 16 bits."""
    a = np.arange(256, dtype=np.int32) ^ 85
    part, low = (a >> 4) & 7, (a & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


MU_LAW_SAMPLES, A_LAW_SAMPLES = mu_law_table(), a_law_table()

# What a code adds to the sample at each step index, and the step index after it: 89 x 16, by rule.
_CODE = np.arange(16, dtype=np.int32)
_SIZE = (STEPS[:, None] >> 3) + np.where(_CODE & 4, STEPS[:, None], 0) + np.where(_CODE & 2, STEPS[:, None] >> 1, 0) + np.where(_CODE & 1, STEPS[:, None] >> 2, 0)
ADPCM_DELTA = np.where(_CODE & 8, -_SIZE, _SIZE).astype(np.int32).ravel()
ADPCM_NEXT = (np.clip(np.arange(89)[:, None] + MOVES[_CODE & 7], 0, 88) * 16).astype(np.int32).ravel()


def decode_adpcm(coded: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, n x bytes: a header of sample (16 bits), step index, spare byte; then codes, low half first."""
    n, size = coded.shape
    head = np.ascontiguousarray(coded[:, :2]).view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(coded[:, 2].astype(np.int32), 88) * 16
    body = np.ascontiguousarray(coded[:, 4:].T)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = head
    value = head
    for k, column in enumerate(body):
        for half, code in ((1, column & 15), (2, column >> 4)):
            at = state + code
            value = np.minimum(np.maximum(value + ADPCM_DELTA[at], -32768), 32767)
            state = ADPCM_NEXT[at]
            out[2 * k + half] = value
    return out.T


def wav(data: bytes, coding: int, rate: int, bits: int) -> bytes:
    """A mono WAV file."""
    width = bits // 8
    extra = b"\0\0" if coding != PCM else b""
    fmt = struct.pack("<HHIIHH", coding, 1, rate, rate * width, width, bits) + extra
    fact = b"fact" + struct.pack("<II", 4, len(data) // width) if coding != PCM else b""
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """Coding, rate and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, coding, rate = 12, 0, 0
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        if media[at : at + 4] == b"fmt ":
            coding, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif media[at : at + 4] == b"data":
            return coding, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def double_rate(samples: np.ndarray) -> np.ndarray:
    """16-bit samples at twice the rate: those given, and between them a windowed-sinc half-band filter in whole numbers; silence stands beyond both ends."""
    n = len(samples)
    x = np.zeros(n + 7, np.int32)
    x[3 : 3 + n] = samples
    between = np.zeros(n, np.int32)
    for k, tap in enumerate((10053, -2436, 731, -156)):  # of 16384; symmetric
        between += tap * (x[3 - k : 3 - k + n] + x[4 + k : 4 + k + n])
    out = np.empty(2 * n, np.int16)
    out[0::2] = samples
    out[1::2] = np.clip((between + 8192) >> 14, -32768, 32767)
    return out


#: What an output column holds. media and pcm are whole WAV files.
OUTPUTS = {
    "n_bytes": T.LongType(),
    "payload_bytes": T.LongType(),
    "payload_sha256": T.StringType(),
    "tail_crc32": T.LongType(),
    "media": T.BinaryType(),
    "media_bytes": T.LongType(),
    "media_sha256": T.StringType(),
    "pcm": T.BinaryType(),
    "pcm_bytes": T.LongType(),
    "pcm_sha256": T.StringType(),
    "feature": T.StringType(),
}


def store_and_read(docs: DataFrame, text_col: str = "text", outputs: tuple[str, ...] = ("n_bytes", "media", "pcm")) -> DataFrame:
    """`docs` with the asked-for OUTPUTS. `feature` is made of whole numbers: energy and zero crossings of the
    mu-law samples, energy of the A-law reading, energy and last samples' sum of the ADPCM blocks, and the
    CRC-32 of the stored PCM."""
    added = T.StructType([T.StructField(c, OUTPUTS[c]) for c in outputs])

    def make():
        asked = set(outputs)

        def work(texts: pa.Array) -> dict:
            data, at = raw(texts)
            files = [wav(padded(data[a:b].tobytes()), MU_LAW, RATE, 8) for a, b in zip(at[:-1], at[1:], strict=True)]
            payloads = [unwav(f)[2] for f in files]
            coded = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
            edge = np.concatenate([[0], np.cumsum([len(p) // BLOCK for p in payloads])])
            if "feature" in asked:
                spoken = decode_adpcm(coded)
                power, last = np.einsum("ij,ij->i", spoken, spoken, dtype=np.int64), spoken[:, -1].astype(np.int64)
                power, last = np.add.reduceat(power, edge[:-1]), np.add.reduceat(last, edge[:-1])
            made: dict = {c: [] for c in outputs}
            for i, (media, payload) in enumerate(zip(files, payloads, strict=True)):
                given = {"n_bytes": at[i + 1] - at[i], "payload_bytes": len(payload), "media": media, "media_bytes": len(media)}
                if "payload_sha256" in asked:
                    given["payload_sha256"] = hashlib.sha256(payload).hexdigest()
                if "tail_crc32" in asked:
                    given["tail_crc32"] = zlib.crc32(payload[-32:])
                if "media_sha256" in asked:
                    given["media_sha256"] = hashlib.sha256(media).hexdigest()
                if asked & {"pcm", "pcm_bytes", "pcm_sha256", "feature"}:
                    code = np.frombuffer(payload, np.uint8)
                    heard = MU_LAW_SAMPLES[code]
                    pcm = wav(double_rate(heard).tobytes(), PCM, 2 * RATE, 16)
                    given["pcm"], given["pcm_bytes"] = pcm, len(pcm)
                    if "pcm_sha256" in asked:
                        given["pcm_sha256"] = hashlib.sha256(pcm).hexdigest()
                    if "feature" in asked:
                        count = np.bincount(code, minlength=256)
                        loud, other = (int(count @ (t.astype(np.int64) ** 2)) // len(code) for t in (MU_LAW_SAMPLES, A_LAW_SAMPLES))
                        up = heard >= 0
                        given["feature"] = f"mu={loud};zc={np.count_nonzero(up[1:] != up[:-1])};a={other};adpcm={power[i] // (spoken.shape[1] * (edge[i + 1] - edge[i]))},{last[i]};pcm={zlib.crc32(pcm):08x}"
                for c in outputs:
                    made[c].append(given[c])
            return made

        return work

    return add_columns(docs, text_col, make, added)


def padded(data: bytes) -> bytes:
    """With PAD bytes, up to a positive multiple of BLOCK."""
    return data + bytes([PAD]) * (-len(data) % BLOCK if data else BLOCK)

"""Round trips and a plain decoder, sample by sample."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import types as T

from docweave.llm import telephony as tel


def plain_adpcm(block: bytes) -> list[int]:
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(tel.STEPS[index])
            diff = step >> 3
            diff += step if code & 4 else 0
            diff += step >> 1 if code & 2 else 0
            diff += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks():
    coded = np.random.default_rng(3).integers(0, 256, (7, 64), dtype=np.uint8)
    got = tel.decode_adpcm(coded)
    assert [list(map(int, g)) for g in got] == [plain_adpcm(bytes(c)) for c in coded]


def test_tables():
    mu, a = tel.MU_LAW_SAMPLES, tel.A_LAW_SAMPLES
    assert mu[0] == -32124 and mu[128] == 32124 and mu[255] == 0 and mu[127] == 0
    assert a[0x55] == -8 and a[0xD5] == 8 and a[0x2A] == -32256 and a[0xAA] == 32256
    assert (mu[:128] == -mu[128:]).all() and len(set(a.tolist())) == 256


def test_double_rate_keeps_samples_and_interpolates():
    x = (8000 * np.sin(np.arange(400) * 0.3)).astype(np.int16)
    y = tel.double_rate(x)
    assert (y[0::2] == x).all()
    want = 8000 * np.sin((np.arange(400) + 0.5) * 0.3)
    assert np.abs(y[1::2][8:-8] - want[8:-8]).max() < 60
    assert len(tel.double_rate(x[:1])) == 2


def test_stored_bytes(spark):
    given = [None, "", "é" * 288, "x" * 575, "y" * 577, "long text " * 200_000, "y" * 577]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("Media", T.StringType())])
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], schema)
    rows = {r.doc_id: r for r in tel.store_and_read(df, outputs=tuple(tel.OUTPUTS)).collect()}
    assert len(rows) == len(given)
    for i, t in enumerate(given):
        b = (t or "").encode()
        want = b + b"\xff" * (576 * max(1, -(-len(b) // 576)) - len(b))
        r = rows[i]
        assert tel.unwav(bytes(r.media)) == (tel.MU_LAW, 8000, want)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(b), len(want), zlib.crc32(want[-32:]), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        coding, rate, pcm = tel.unwav(bytes(r.pcm))
        assert (coding, rate) == (tel.PCM, 16000)
        assert (np.frombuffer(pcm, "<i2")[::2] == tel.MU_LAW_SAMPLES[np.frombuffer(want, np.uint8)]).all()
    assert rows[4].feature == rows[6].feature and rows[0].feature == rows[1].feature


def plain_mu(byte):
    u = ~byte & 255
    size = (((u & 15) * 8 + 132) << ((u >> 4) & 7)) - 132
    return -size if u & 128 else size


def plain_a(byte):
    a = byte ^ 0x55
    part, low = (a >> 4) & 7, (a & 15) * 16
    size = low + 8 if part == 0 else (low + 264) << (part - 1)
    return size if a & 128 else -size


def plain_pcm(samples):
    """Twice the rate, a sample at a time; silence beyond both ends."""
    out = []
    for i, x in enumerate(samples):
        at = lambda k: samples[k] if 0 <= k < len(samples) else 0
        total = sum(tap * (at(i - k) + at(i + 1 + k)) for k, tap in enumerate((10053, -2436, 731, -156)))
        out += [x, max(-32768, min(32767, (total + 8192) >> 14))]
    return b"".join(int(x).to_bytes(2, "little", signed=True) for x in out)


def test_feature_and_pcm_by_the_definition(spark):
    given = ["", "é" * 40, "A telephone call about 3 things. " * 30, "\x7f\x00" * 700]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    for r in tel.store_and_read(df, outputs=("feature", "pcm", "pcm_bytes", "pcm_sha256")).collect():
        b = given[r.doc_id].encode()
        payload = b + b"\xff" * (576 * max(1, -(-len(b) // 576)) - len(b))
        mu, a = [plain_mu(x) for x in payload], [plain_a(x) for x in payload]
        spoken = [plain_adpcm(payload[i : i + 576]) for i in range(0, len(payload), 576)]
        flat = [x for block in spoken for x in block]
        pcm = plain_pcm(mu)
        assert tel.unwav(bytes(r.pcm)) == (tel.PCM, 16000, pcm) and r.pcm_bytes == len(r.pcm) and r.pcm_sha256 == hashlib.sha256(bytes(r.pcm)).hexdigest()
        energy = lambda x: sum(v * v for v in x) // len(x)
        crossings = sum((x >= 0) != (y >= 0) for x, y in zip(mu, mu[1:], strict=False))
        want = f"mu={energy(mu)};zc={crossings};a={energy(a)};adpcm={energy(flat)},{sum(block[-1] for block in spoken)};pcm={zlib.crc32(bytes(r.pcm)):08x}"
        assert r.feature == want


def test_empty_table(spark):
    assert tel.store_and_read(spark.createDataFrame([], "doc_id long, text string")).collect() == []

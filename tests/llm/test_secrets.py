"""Spans against a plain scan, windows against entropies counted afresh, and the text without them."""

import hashlib
import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import secrets

WORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"""({WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def plain_entropy(text, base):
    left = list(text or "")
    for a, _, b in base:
        left[a:b] = " " * (b - a)
    left = re.sub(secrets.ALLOWED, lambda m: " " * len(m[0]), "".join(left))
    for m in re.finditer("[A-Za-z0-9+/_=-]+", left):
        s = m[0]
        if len(s) < 20 or not re.search("[A-Za-z]", s):
            continue
        if re.fullmatch("[0-9A-Fa-f]+", s):
            bits = 3.0
        elif re.search("[0-9]", s):
            bits = 3.7
        elif re.search("[a-z]", s) and re.search("[A-Z][a-z]*[A-Z]", s):
            bits = 4.1
        else:
            continue
        if any(-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) >= bits for i in range(len(s) - 19)):
            yield m.start(), 3, m.end()


def texts():
    rnd = random.Random(9)
    b64 = secrets.ALPHABET
    out = [None, "", "token=ab token=secret:abcdefghijklmnopq", "AKIAAKIA" + "Z" * 12 + " AKIA123", "PassWord \": 'aaaaaaaaaaaa ſecret=abcdefabcdef", "é🤷 api_key==0123456789abcdef0 tail"]
    out += ["123e4567-e89b-12d3-a456-426614174000", "x" * 400_000 + " token=abcdefghijkl", "EXAMPLEkey9aB8cD7eF6gH5iJ4", "a1B2c3D4e5F6g7H8i9J0k1L2", "0123456789" * 9, "ab12" * 500, "secret=" * 300]
    out += ["/example/" + "".join(rnd.choice(b64[:62]) for _ in range(40)), "AAAAAAAAkd83KDk3ldkKD93kdlkDK3mvVc8Qz", "your_key=" + "".join(rnd.choice(b64[:62]) for _ in range(30))]
    out += ["id=123e4567-e89b-12d3-a456-426614174000" + "/" + "".join(rnd.choice(b64[:62]) for _ in range(24)), "0123456789abcdef0+" + "".join(rnd.choice(b64[:62]) for _ in range(24)), "token=abcdefghijkl " * 700]
    for _ in range(400):
        parts = []
        for _ in range(rnd.randrange(1, 8)):
            parts.append(rnd.choice(["the", "Zuß", "🤷", "token=", "Secret : '", "AKIA", "AKIA" + "Q7" * 8, "api-key=", "\n", " ", "=", ""]))
            parts.append("".join(rnd.choice(rnd.choice([b64, "0123456789abcdef", "0123456789ABCDEF", "abc", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123"])) for _ in range(rnd.choice([0, 3, 11, 12, 15, 17, 22, 40]))))
        out.append("".join(parts))
    return out + ["".join(rnd.choice(alphabet) for _ in range(n)) for alphabet in (b64, "0123456789ABCDEFabcdef", b64[:52]) for n in (20, 21, 30, 60) for _ in range(8)]


def test_spans_match_a_plain_scan(spark):
    given = texts()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("Spans", T.StringType()), T.StructField("found", T.StringType())])
    df = spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(given)] + [(2, given[2], None, None)], schema).repartition(8)
    out = secrets.scan(df)
    text = F.coalesce("text", F.lit(""))
    rows = out.select("doc_id", "spans", secrets.redacted(text, F.col("spans")).alias("clean"), F.sha2(secrets.listed(F.col("spans")), 256).alias("sha")).collect()
    assert len(rows) == len(given) + 1 and out.columns == ["doc_id", "text", "found", "spans"]
    kinds = Counter()
    for r in rows:
        base = plain_base(given[r.doc_id])
        want = sorted(base + list(plain_entropy(given[r.doc_id], base)))
        assert [(s.start, s.rank, s.end) for s in r.spans] == want, given[r.doc_id]
        kinds.update(s.kind for s in r.spans)
        assert r.sha == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        left, at = "", 0
        for a, _, b in want:
            left += given[r.doc_id][at:a] + "[secret]" if a >= at else ""
            at = max(at, b)
        assert r.clean == left + (given[r.doc_id] or "")[at:]
    assert min(kinds[k] for k in secrets.KINDS) > 2


def test_a_long_random_candidate_is_scanned_in_linear_time(spark):
    rnd = random.Random(3)
    blob = "".join(rnd.choice(secrets.ALPHABET[:64]) for _ in range(300_000))
    took = []
    for n in (30_000, 300_000):
        df = spark.createDataFrame([(1, "see " + blob[:n])], "doc_id long, text string")
        for _ in range(2):
            began = time.perf_counter()
            spans = secrets.scan(df).first().spans
            once = time.perf_counter() - began
        took.append(once)
        base = plain_base("see " + blob[:n])
        assert sorted((s.start, s.rank, s.end) for s in spans) == sorted(base + list(plain_entropy("see " + blob[:n], base)))
        assert any(s.kind == "entropy" for s in spans)
    assert took[1] < 30 * max(took[0], 0.5), took


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []

"""Streams with state against plain walks over the same events."""

import datetime as dt
import random

import pytest

from docweave.operators import jobs
from docweave.streaming import stateful, windows

START = dt.datetime(2024, 1, 1)


def files(spark, folder, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return windows.read(spark, folder, schema.replace(" long", " bigint"), files=1)


def out(stream, tmp_path, spark):
    windows.drain(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()


def limits(events, most, seconds):
    """By the definition: all events of a key up to this moment, within the seconds before it."""
    made = {}
    for key, at, seq in events:
        seen = sorted(a for k, a, _ in events if k == key and a <= at)[-most - 1 :]
        over = len(seen) > most and (at - seen[0]).total_seconds() <= seconds
        wait = -((at - seen[0] - dt.timedelta(seconds=seconds)) // dt.timedelta(seconds=1)) if over else None
        made[seq] = (not over, max(1, wait) if over else None)
    return made


@pytest.mark.parametrize("most", [1, 3])
def test_limits_of_a_stream(spark, tmp_path, most):
    rnd = random.Random(most)
    events = [(rnd.choice("ab"), START + dt.timedelta(seconds=rnd.randrange(4000), milliseconds=rnd.choice([0, 0, 250])), i) for i in range(120)]
    rows = [(*e, "x") for e in events]
    rnd.shuffle(rows)
    schema = "key string, ts timestamp, seq long, kind string"
    stream = files(spark, f"{tmp_path}/in", [rows[:50], rows[50:90], rows[90:], [("end", START + dt.timedelta(days=1), -1, "x")]], schema)
    got = out(stateful.rate_limited(stream, "key", most, 300, "2 hours"), tmp_path, spark)
    want = limits(events, most, 300)
    assert {r.seq: (r.allowed, r.retry_after) for r in got} == want and len(got) == len(want)
    batch = jobs.retry_after(spark.createDataFrame(rows, schema), "key", most, 300, seq="seq").collect()
    assert {r.seq: (r.allowed, r.retry_after) for r in batch} == want


def walk(events, lease, until):
    """A plain walk over one job's events."""
    state, tries, deadline, made = None, 0, None, []

    def wait(now):
        nonlocal state, tries, deadline
        if deadline is not None and deadline <= now:
            if state == "processing":
                tries += 1
                state = "failed" if tries > jobs.RETRIES else "pending"
                made.append((deadline, "lease", state, tries))
            else:
                made.append((deadline, "due", state, tries))
            deadline = None

    for at, kind in sorted(events):
        wait(at)
        before = state, deadline
        if kind == "created" and state is None:
            state = "pending"
        elif kind == "claimed" and before == ("pending", None):
            state, deadline = "processing", at + lease
        elif kind == "completed" and state == "processing":
            state, deadline = "completed", None
        elif kind == "error" and state == "processing":
            last = tries >= jobs.RETRIES
            tries += not last
            state, deadline = ("failed", None) if last else ("pending", at + min(jobs.LONGEST, 2**tries))
        else:
            continue
        made.append((at, kind, state, tries))
    wait(until)
    return made


def test_jobs_of_a_stream(spark, tmp_path):
    rnd = random.Random(8)
    events = {}
    while len(events) < 260:
        events[rnd.randrange(9), rnd.randrange(0, 9000, 2)] = rnd.choice(["created", "claimed", "claimed", "claimed", "error", "error", "completed"])
    rows = [(job, START + dt.timedelta(seconds=at), i, kind) for i, ((job, at), kind) in enumerate(events.items())]
    rnd.shuffle(rows)
    schema = "job long, ts timestamp, seq long, kind string"
    stream = files(spark, f"{tmp_path}/in", [rows[:100], rows[100:], [(-1, START + dt.timedelta(days=2), -1, "end")]], schema)
    got = out(stateful.job_states(stream, "4 hours", lease=600), tmp_path, spark)
    zero = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    for job in range(9):
        want = walk([(at, kind) for (j, at), kind in events.items() if j == job], 600, 10**6)
        assert sorted((r.micros // 10**6 - zero, r.cause, r.state, r.tries) for r in got if r.job == job) == sorted(want)
    assert {r.cause for r in got} == {"created", "claimed", "completed", "error", "lease", "due"}


def test_sketches_merge(spark):
    rnd = random.Random(1)
    rows = [("a", START + dt.timedelta(hours=i % 240), rnd.lognormvariate(0, 2)) for i in range(20_000)] + [("b", START, None), ("c", START, 7.0)]
    events = spark.createDataFrame(rows, "event_type string, ts timestamp, value double")
    days = windows.sketched(events, "1 day")
    assert days.count() == 12
    got = {r.event_type: r for r in windows.merged_quantiles(days, ["event_type"], {"p50": 0.5, "p99": 0.99}).collect()}
    values = sorted(r[2] for r in rows if r[0] == "a")
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        assert abs(sum(v <= got["a"][name] for v in values) / len(values) - q) <= windows.ERROR
    assert got["c"].p50 == 7.0 and got["b"].n == 0 and got["b"].p50 is None


def test_limits_of_no_events(spark):
    empty = spark.createDataFrame([], "key string, ts timestamp, seq long")
    assert jobs.retry_after(empty, "key", 2, 60, seq="seq").collect() == []


def test_keys_are_passed_as_rows(spark, tmp_path):
    """No table in memory for each key and its events."""
    schema = "job long, ts timestamp, seq long, kind string"
    stream = files(spark, f"{tmp_path}/in", [[(1, START, 0, "created")]], schema)
    for made in (stateful.job_states(stream, "1 hour"), stateful.rate_limited(stream, "job", 1, 60, "1 hour")):
        assert "pandas" not in made._jdf.queryExecution().logical().toString().lower()

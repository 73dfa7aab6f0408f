"""Streams with state by key and timers: limits of rates, and jobs whose leases expire and whose retries come due.

Events are held back until the watermark has passed them, and are then taken in the order of their time. What comes late
within the watermark's delay thus counts as if it had come in time, and a stream gives what the batch form gives over the
same events. State is bounded: a key keeps what came within the delay, and a few values.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweave.operators.jobs import LEASE, LONGEST, RETRIES

#: Keyed state with timers needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Set the store that streams of this session keep their state in."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _InOrder(StatefulProcessor):
    """Holds events (micros, seq, kind) back until the watermark has passed them; `advance` gets them in order, with the time up to which all is known."""

    OUT: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "micros bigint, seq bigint, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [(r.micros, r.seq, r.kind) for r in rows]
        self.pending.appendList(came)
        self.handle.registerTimer(-(-min(r[0] for r in came) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        due = [r for r in held if r[0] <= known]
        left = held[len(due) :]
        if due:
            self.pending.put(left) if left else self.pending.clear()
            if left:
                self.handle.registerTimer(-(-left[0][0] // 1000))
        for row in self.advance(due, known):  # rows, since a table in memory for each key costs more than its events
            yield Row(*self.OUT)(*key, *row)

    def advance(self, events: list[tuple], known: int) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class RateLimit(_InOrder):
    """Keeps the times of a key's last `most` events: an event is allowed if fewer of them lie within the seconds before it, and else waits until the oldest of them has left."""

    OUT = ["key", "seq", "allowed", "retry_after"]

    def __init__(self, most: int, seconds: int):
        self.most, self.width = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getListState("last", "micros bigint")

    def advance(self, events: list[tuple], known: int) -> list[tuple]:
        last = [r[0] for r in self.last.get()] if self.last.exists() else []
        if not events:
            if last and last[-1] + self.width < known:  # an idle key
                self.last.clear()
            return []
        made = []
        for at, group in groupby(events, key=lambda e: e[0]):
            of_moment = [seq for _, seq, _ in group]  # events of one moment count for each other, as in a window over a range of time
            last = (last + [at] * min(len(of_moment), self.most + 1))[-self.most - 1 :]
            over = len(last) > self.most and last[0] >= at - self.width
            wait = max(1, -(-(last[0] + self.width - at) // 1_000_000)) if over else None
            made += [(seq, not over, wait) for seq in of_moment]
            last = last[-self.most :]
        self.last.put([(m,) for m in last])
        self.handle.registerTimer((last[-1] + self.width) // 1000 + 1)
        return made


class Jobs(_InOrder):
    """The life of a job. Events: created, claimed, completed, error. A claim holds for `lease` seconds; then the job is pending again with one try more, or failed after RETRIES. An error waits 2, 4, 8, ... seconds, or ends the job."""

    OUT = ["job", "micros", "cause", "state", "tries"]

    def __init__(self, lease: int = LEASE):
        self.lease = lease * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "state string, tries int, until bigint")

    def advance(self, events: list[tuple], known: int) -> list[tuple]:
        state, tries, until = tuple(self.job.get()) if self.job.exists() else (None, 0, None)
        made = []

        def pass_time(now: int) -> None:
            nonlocal state, tries, until
            if until is None or until > now:
                return
            if state == "processing":
                tries += 1
                state = "failed" if tries > RETRIES else "pending"
                made.append((until, "lease", state, tries))
            else:
                made.append((until, "due", state, tries))
            until = None

        for at, _, kind in events:
            pass_time(at)
            if kind == "created" and state is None:
                state = "pending"
            elif kind == "claimed" and state == "pending" and until is None:
                state, until = "processing", at + self.lease
            elif kind == "completed" and state == "processing":
                state, until = "completed", None
            elif kind == "error" and state == "processing":
                until = None
                if tries >= RETRIES:
                    state = "failed"
                else:
                    tries += 1
                    state, until = "pending", at + min(LONGEST, 2**tries) * 1_000_000
            else:
                continue
            made.append((at, kind, state, tries))
        pass_time(known)
        if state is not None:
            self.job.update((state, tries, until))
        if until is not None:
            self.handle.registerTimer(-(-until // 1000))
        return made


def _with_state(events: DataFrame, key: str, late: str, processor: StatefulProcessor, out: str) -> DataFrame:
    keyed_state(events.sparkSession)
    rows = events.withWatermark("ts", late).selectExpr(f"{key} as key", "ts", "unix_micros(ts) as micros", "seq", "kind")
    return rows.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventTime")


def rate_limited(events: DataFrame, key: str, most: int, seconds: int, late: str) -> DataFrame:
    """key, seq, allowed, retry_after of a stream of events (key, ts, seq, kind): what operators.jobs.rate_limited gives, and the seconds to wait."""
    kind = dict(events.dtypes)[key]
    return _with_state(events, key, late, RateLimit(most, seconds), f"key {kind}, seq bigint, allowed boolean, retry_after bigint")


def job_states(events: DataFrame, late: str, lease: int = LEASE) -> DataFrame:
    """job, micros, cause, state, tries: all changes of the jobs of a stream of events (job, ts, seq, kind), those that time brings included."""
    kind = dict(events.dtypes)["job"]
    return _with_state(events, "job", late, Jobs(lease), f"job {kind}, micros bigint, cause string, state string, tries int")

"""State of jobs, claims, retries, and limits of rates, as table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a lease, retries before a job has failed, longest wait before a retry in seconds.
LEASE, RETRIES, LONGEST = 2100, 3, 300
# A document's state by that of its last job.
DOCUMENT_STATES = {"pending": "queued", "processing": "processing", "completed": "indexed", "failed": "failed"}


def expired_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """`jobs` in work (claimed_at, tries) with their state: an expired lease is one try more, and pending or failed."""
    over = F.col("claimed_at") <= now - F.make_dt_interval(secs=F.lit(LEASE))
    tries = F.when(over, F.col("tries") + 1).otherwise(F.col("tries"))
    state = F.when(over & (tries > RETRIES), "failed").when(over, "pending").otherwise("processing")
    return jobs.withColumn("state", state).withColumn("tries", tries)


def claimed(jobs: DataFrame, now: Column, batch: int) -> DataFrame:
    """The `batch` oldest pending jobs (id, state, created_at, next_at) that are due, as they are when claimed. A claim is one write of this result: a batch with the same number is written once."""
    due = jobs.where((F.col("state") == "pending") & (F.col("next_at").isNull() | (F.col("next_at") <= now))).orderBy("created_at", "id").limit(batch)
    return due.withColumn("state", F.lit("processing")).withColumn("claimed_at", now)


def after_failure(jobs: DataFrame, now: Column) -> DataFrame:
    """Failed attempts (id, tries, error) with state, tries, next_at and message: pending again after 2, 4, 8, ... seconds, or failed for good."""
    last = F.col("tries") >= RETRIES
    tries = F.when(last, F.col("tries")).otherwise(F.col("tries") + 1)
    wait = F.least(F.lit(LONGEST), F.pow(F.lit(2), tries)).cast("int")
    lead = F.when(last, F.concat(F.lit("Failed after "), tries.cast("string"), F.lit(f"/{RETRIES} attempts: "))).otherwise(F.concat(F.lit("Attempt "), tries.cast("string"), F.lit(f"/{RETRIES} failed: ")))
    return jobs.select(
        "id", F.when(last, "failed").otherwise("pending").alias("state"), tries.alias("tries"), F.when(~last, now + F.make_dt_interval(secs=wait)).alias("next_at"), F.concat(lead, F.substring("error", 1, 500)).alias("message")
    )


def current(events: DataFrame) -> DataFrame:
    """The state of each job after its events (job, at, seq, state): that of the last; a job that has ended stays so; and its document's state."""
    over = F.min(F.when(F.col("state").isin("completed", "failed"), F.struct("at", "seq"))).over(W.partitionBy("job"))
    valid = events.withColumn("over", over).where(F.col("over").isNull() | (F.struct("at", "seq") <= F.col("over")))
    last = valid.groupBy("job").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.count("*").alias("n_events"))
    states = F.create_map(*[F.lit(x) for pair in DOCUMENT_STATES.items() for x in pair])
    return last.withColumn("document_state", F.element_at(states, F.col("state")))


def rate_limited(events: DataFrame, key: str, most: int, seconds: int) -> DataFrame:
    """`events` with allowed: no more than `most` events of a key in the seconds up to it."""
    own = W.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("allowed", F.count("*").over(own) <= most)


def retry_after(events: DataFrame, key: str, most: int, seconds: int, seq: str = "event_id") -> DataFrame:
    """`events` with allowed, and retry_after: seconds until the event is allowed that comes after the last `most` ones, at least 1; null for those allowed. Events of one moment count for each other."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = W.partitionBy(key).orderBy("__at")
    rows = events.withColumn("__at", micros).withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("__at", seq))).withColumn("__upto", F.count("*").over(own.rangeBetween(W.unboundedPreceding, 0)))
    first = rows.select(F.col(key).alias("__key"), (F.col("__n") + most).alias("__place"), F.col("__at").alias("__first"))
    joined = rows.join(first, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__upto") == F.col("__place")), "left")
    left = F.col("__first") + seconds * 1_000_000 - F.col("__at")
    allowed = F.coalesce(left < 0, F.lit(True))
    wait = F.when(~allowed, F.greatest(F.lit(1), F.ceil(left / 1_000_000)).cast("long"))
    return joined.select(*[events[c] for c in events.columns], allowed.alias("allowed"), wait.alias("retry_after"))

"""Queries that run as streams over the events, some of which come late, and end when all are taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import jobs
from docweave.plans.registry import query
from docweave.session import scratch, table
from docweave.streaming import stateful, windows

#: How late an event may come; the time of the event that closes a stream.
LATE, CLOSED = "20 days", "2024-08-01"
#: Seconds that a claim holds in these queries: events of a job are hours apart.
HOLD = 43_200


def _arriving(rows: DataFrame, schema: str) -> DataFrame:
    """A stream of `rows` (ts, seq, ...): a file for each eight days, every twentieth event a file late, and one that closes it."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, "arriving")
    names = [f.name for f in rows.schema]
    when = F.least(F.floor(F.dayofyear("ts") / 8) + (F.col("seq") % 20 == 0).cast("int"), F.lit(4))
    placed = rows.withColumn("__file", when)
    for k in range(5):
        placed.where(F.col("__file") == k).select(names).coalesce(1).write.mode("append").parquet(folder)
    closing = [F.to_timestamp(F.lit(CLOSED)).alias(n) if n == "ts" else F.lit(-1).cast(rows.schema[n].dataType).alias(n) for n in names]
    spark.range(1).select(closing).write.mode("append").parquet(folder)
    return windows.read(spark, folder, schema, files=1)


def _drained(stream: DataFrame) -> DataFrame:
    spark, folder = stream.sparkSession, scratch(stream.sparkSession, "drained")
    windows.drain(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


_LIMITS = """with e as (select event_id, user_id, epoch_us(ts) as at, row_number() over (partition by user_id order by ts, event_id) as n, count(*) over (partition by user_id order by ts range unbounded preceding) as upto from events),
  f as (select e.event_id, e.user_id, f.at + 3600000000 - e.at as left_ from e left join e f on f.user_id = e.user_id and f.n + 2 = e.upto)
  select event_id, user_id, coalesce(left_ < 0, true) as allowed, case when left_ >= 0 then greatest(1, cast(ceil(left_ / 1000000) as bigint)) end as retry_after from f"""


@query("sm07_limits_with_waits", _LIMITS)
def sm07_waits(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return jobs.retry_after(e, "user_id", most=2, seconds=3600).select("event_id", "user_id", "allowed", "retry_after")


@query("sm07_limits_of_a_stream", _LIMITS)
def sm07_stream(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.lit("request").alias("kind"))
    stream = _arriving(e, "user_id bigint, ts timestamp, seq bigint, kind string")
    return _drained(stateful.rate_limited(stream, "user_id", 2, 3600, LATE)).select(F.col("seq").alias("event_id"), F.col("key").alias("user_id"), "allowed", "retry_after")


_KINDS = {"signup": "created", "view": "claimed", "click": "claimed", "purchase": "completed", "error": "error"}


@query("sm05_jobs_of_a_stream", f"""with recursive given as (select user_id * 10 + week(ts) as job, epoch_us(ts) as tm, event_id as seq,
    case event_type when 'signup' then 'created' when 'purchase' then 'completed' when 'error' then 'error' else 'claimed' end as kind from events),
  closed as (select * from given union all select distinct job, 9000000000000000, 0, 'end' from given),
  listed as (select *, row_number() over (partition by job order by tm, seq) as k from closed),
  walk as (
    select job, 0::bigint as k, null::varchar as state, 0 as tries, null::bigint as until, []::struct(micros bigint, cause varchar, state varchar, tries int)[] as made from (select distinct job from given)
    union all
    select job, k, case when c then 'pending' when l then 'processing' when d then 'completed' when e and tries >= {jobs.RETRIES} then 'failed' when e then 'pending' else state end,
      tries2, case when l then tm + {HOLD}000000 when e and tries < {jobs.RETRIES} then tm + least({jobs.LONGEST}, 2 ** tries2)::bigint * 1000000 when d or e then null else until end,
      case when c or l or d or e then list_append(made, {{'micros': tm, 'cause': kind, 'state': case when c then 'pending' when l then 'processing' when d then 'completed' when tries >= {jobs.RETRIES} then 'failed' else 'pending' end, 'tries': tries2}}) else made end
    from (select *, kind = 'created' and state is null as c, kind = 'claimed' and coalesce(state = 'pending', false) and until is null as l, kind = 'completed' and coalesce(state = 'processing', false) as d, kind = 'error' and coalesce(state = 'processing', false) as e,
        cast(tries + case when kind = 'error' and coalesce(state = 'processing', false) and tries < {jobs.RETRIES} then 1 else 0 end as int) as tries2
      from (select job, k, tm, kind, case when lease then case when tries + 1 > {jobs.RETRIES} then 'failed' else 'pending' end else state end as state, cast(tries + lease::int as int) as tries, case when fires then null else until end as until,
          case when fires then [{{'micros': until, 'cause': case when lease then 'lease' else 'due' end, 'state': case when lease and tries + 1 > {jobs.RETRIES} then 'failed' else 'pending' end, 'tries': cast(tries + lease::int as int)}}] else [] end as made
        from (select n.job, n.k, n.tm, n.kind, w.state, w.tries, w.until, coalesce(w.until <= n.tm, false) as fires, coalesce(w.until <= n.tm and w.state = 'processing', false) as lease from walk w join listed n on n.job = w.job and n.k = w.k + 1)))
  )
  select job, m.micros, m.cause, m.state, m.tries from (select job, unnest(made) as m from walk)""")
def sm05_stream(spark, sf):
    """Jobs of users by week: claims that run out, retries that come due, late events; every change of state."""
    e = table(spark, sf, "events")
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    ts = F.col("ts").cast("timestamp")
    rows = e.select((F.col("user_id") * 10 + F.weekofyear("ts")).alias("job"), ts.alias("ts"), F.col("event_id").alias("seq"), F.element_at(kinds, F.col("event_type")).alias("kind"))
    return _drained(stateful.job_states(_arriving(rows, "job bigint, ts timestamp, seq bigint, kind string"), LATE, lease=HOLD))


_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _near(sketches: DataFrame, events: DataFrame) -> DataFrame:
    """event_type, n, and whether the rank of each quantile of the merged sketches is within the stated error of the exact one."""
    found = windows.merged_quantiles(sketches, ["event_type"], _SHARES)
    ranks = events.join(F.broadcast(found), "event_type").groupBy("event_type").agg(  # a row for each type of events
        F.first("n").alias("n"), *[(F.count_if(F.col("value") < F.col(p)) / F.count("value") - q <= windows.ERROR).alias(f"{p}_low") for p, q in _SHARES.items()], *[(q - F.count_if(F.col("value") <= F.col(p)) / F.count("value") <= windows.ERROR).alias(f"{p}_high") for p, q in _SHARES.items()]
    )
    return ranks.select("event_type", "n", *[(F.col(f"{p}_low") & F.col(f"{p}_high")).alias(p) for p in _SHARES])


_SKETCHED = "select event_type, count(value) as n, true as p50, true as p95, true as p99 from events group by event_type"


@query("ag19_merged_sketches", _SKETCHED)
def ag19_sketches(spark, sf):
    """Latency quantiles from a sketch a day, merged."""
    e = table(spark, sf, "events").select("ts", "event_type", "value")
    return _near(windows.sketched(e, "1 day"), e)


@query("sm11_sketches_of_a_stream", _SKETCHED)
def sm11_sketches(spark, sf):
    """The same from a stream with late events, which writes each day's sketch when the day is over."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "event_type", "value")
    stream = _arriving(e, "ts timestamp, seq bigint, event_type string, value double")
    return _near(_drained(windows.sketched(stream, "1 day", LATE)).where("event_type <> '-1'"), e)

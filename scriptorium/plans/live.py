"""Queries of streams: the given tables arrive part by part, and each part goes on from the checkpoint of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.plans.state import STATUS
from scriptorium.plans.texts import query
from scriptorium.session import new_dir, ship, table
from scriptorium.streaming import stateful, streams
from scriptorium.streaming.tables import KeyedTable

PARTS = 3


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by names that stateful processors know."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"), "event_type", "value")


@query("stream_latest", "select user_id, max_by(event_type, (ts, event_id)) as event_type, max(event_id) filter (event_type = 'error') as last_error from events group by user_id")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into a keyed table, and that table at the end."""
    return streams.latest_by_stream(spark, f"{sf_dir}/events.parquet")


@query("stream_windows", """
select day, event_type, n, total from (select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2)
where day + interval 1 day <= (select date_trunc('milliseconds', max(ts)) - interval 1 day from events)""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day of a stream, of the days that the watermark has closed."""
    e, out = _events(spark, sf_dir).select("ts", "event_type", "value"), new_dir(spark, "days")
    stateful.replay(spark, e, stateful.spans(e, "ts", PARTS), lambda rows, log: stateful.drain(streams.daily(rows), log, path=out))
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", """
with e as (select user_id, event_id, ts, ts - min(ts) over () as since, max(ts) over () - min(ts) over () as whole from events),
k as (select * from e where not (event_id % 97 = 0 and since < whole / 6)),
b as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from k),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as n from b)
select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as n, min(event_id) as first, max(event_id) as last from s group by user_id, s.n
having max(ts) + interval 6 hour <= (select date_trunc('milliseconds', max(ts)) - interval 11 day from events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with breaks of six hours: a tenth of the rows arrives a part late, in time; some of its first days arrive two parts late, and are dropped."""
    e = _events(spark, sf_dir).select(F.col("job").alias("user_id"), "ts", "seq")
    at = F.lit(0)
    for k, part in enumerate(stateful.spans(e, "ts", PARTS)):
        at = F.when(part, k).otherwise(at)
    first, *_ = stateful.spans(e, "ts", 2 * PARTS)
    slow = F.when((F.col("seq") % 97 == 0) & first, 2).when(F.col("seq") % 10 == 0, F.least(at + 1, F.lit(PARTS - 1))).otherwise(at)
    out = new_dir(spark, "sessions")
    stateful.replay(spark, e, [slow == k for k in range(PARTS)], lambda rows, log: stateful.drain(streams.sessions(rows, "user_id", "6 hours", "11 days"), log, path=out))
    return spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_memory", """
with o as (select o_custkey, o_orderkey % 13 + 1 as number, strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(o_orderkey::varchar, 12, '0') as version, 'k' || o_orderkey % 7 as symbol, o_orderpriority as p from orders),
l as (select *, row_number() over (partition by o_custkey, number order by version desc) as v from o),
m as (select *, row_number() over (partition by o_custkey order by number desc) as r from l where v = 1),
g as (select o_custkey, symbol, min(version) as place, max_by(p, version) as meaning from o group by all)
select o_custkey, 'lesson' as kind, number::varchar as name, version, case when r <= 3 then p end as detail from m
union all select o_custkey, 'symbol', symbol, place, meaning from (select *, row_number() over (partition by o_custkey order by place desc) as r from g) where r <= 4
union all select o_custkey, 'next', (max(number) + 1)::varchar, '', null from o group by o_custkey""")
def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lessons of courses that arrive year by year: each course's lessons, symbols and next number at the end."""
    ship(spark)
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    symbol = F.struct(F.concat(F.lit("k"), (key % 7).cast("string")).alias("symbol"), F.col("o_orderpriority").alias("meaning"))
    rows = o.select(
        F.col("o_custkey").alias("course"), (key % 13 + 1).alias("number"), F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lpad(key.cast("string"), 12, "0")).alias("version"),
        F.col("o_orderstatus").alias("title"), F.array("o_orderpriority").alias("concepts"), F.array("o_orderstatus").alias("definitions"), F.col("o_orderstatus").alias("topic"), F.array(symbol).alias("symbols"), "o_orderdate",
    )
    memory = KeyedTable(spark, new_dir(spark, "memory"), stateful.schema_of(stateful.COURSE), "course")
    run = lambda rows, log: stateful.drain(stateful.course_memory(rows, keep=3, most=4), log, write=stateful.memory_into(memory), mode="update")
    stateful.replay(spark, rows, stateful.spans(rows, "o_orderdate", PARTS), run)
    m = memory.read().withColumnRenamed("course", "o_custkey")
    lessons = m.select("o_custkey", F.explode("lessons").alias("x")).select("o_custkey", F.lit("lesson").alias("kind"), F.col("x.number").cast("string").alias("name"), "x.version", F.col("x.concepts")[0].alias("detail"))
    symbols = m.select("o_custkey", F.explode("symbols").alias("x")).select("o_custkey", F.lit("symbol").alias("kind"), F.col("x.symbol").alias("name"), F.col("x.place").alias("version"), F.col("x.meaning").alias("detail"))
    return lessons.unionByName(symbols).unionByName(m.select("o_custkey", F.lit("next").alias("kind"), F.col("next_number").cast("string").alias("name"), F.lit("").alias("version"), F.lit(None).cast("string").alias("detail")))


LINE = "case when event_id % 5 = 0 then '  ' else event_type || ' ' || event_id end"


@query("stream_log_tail", f"""
with e as (select user_id as job, epoch_us(ts) // 1000 as t, event_id, {STATUS} as status, {LINE} as line from events),
w as (
  select *, cast(sum(length(line) + 1) over (partition by job order by t, event_id rows unbounded preceding) as bigint) as characters,
    lead(t) over (partition by job order by t, event_id) as following, max(t) over () as reached from e)
select job, characters, line from w where trim(line) <> ''
union all select job, characters, '[FINE]' from w where status in ('done', 'error') and coalesce(following, reached) - t > 6 * 3600 * 1000""")
def stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as lines of a log, with the reader's offset; the end is marked when a finished job has been silent for six hours."""
    ship(spark)
    line = F.when(F.col("seq") % 5 == 0, "  ").otherwise(F.concat_ws(" ", "event_type", F.col("seq").cast("string")))
    e, out = _events(spark, sf_dir).select("job", "ts", "seq", "status", line.alias("line")), new_dir(spark, "tail")
    stateful.replay(spark, e, stateful.spans(e, "ts", PARTS), lambda rows, log: stateful.drain(stateful.log_tail(rows, 6 * 3600), log, path=out))
    return spark.read.parquet(out)


@query("stream_heartbeat", f"""
with e as (select user_id as job, epoch_us(ts) // 1000 as t, event_id, {STATUS} as status from events),
w as (select *, coalesce(lead(t) over (partition by job order by t, event_id), max(t) over ()) as until from e),
b as (select job, t, k * 15 as passed from (select *, unnest(range(1, 41)) as k from w where status = 'running') where t + k * 15000 < until)
select job, make_timestamp_ms(t + passed * 1000) as at, cast(floor(10 + least(passed / 600.0, 0.95) * 30 + 1e-9) as integer) as progress, cast(passed as integer) as passed from b""")
def stream_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats every 15 seconds between the start of a running step and its user's next event, for ten minutes at most."""
    ship(spark)
    e, out = _events(spark, sf_dir).select("job", "ts", "seq", "status"), new_dir(spark, "beats")
    stateful.replay(spark, e, stateful.spans(e, "ts", PARTS), lambda rows, log: stateful.drain(stateful.heartbeats(rows), log, path=out))
    return spark.read.parquet(out).withColumn("at", F.col("at").cast("timestamp_ntz"))


BOARD_STATUS, BOARD_CAP, BOARD_AGE = "case when event_id % 211 = 0 then 'running' when event_type = 'error' then 'error' else 'done' end", 2000, 3 * 86_400


@query("stream_board", f"""
with j as (select event_id, epoch_us(ts) // 1000 as t, {BOARD_STATUS} as status from events),
f as (select *, row_number() over (order by t desc, event_id desc) as r from j where status <> 'running'),
a as (select count(*) as n from j where status = 'running')
select event_id, status from j where status = 'running'
union all select event_id, status from f, a where r <= greatest(0, {BOARD_CAP} - n) and t >= (select max(t) from j) - {BOARD_AGE}000""")
def stream_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs: what the board shows at the end, of at most 2,000 jobs, the finished ones of the last three days."""
    ship(spark)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.expr(BOARD_STATUS).alias("status"))
    jobs = KeyedTable(spark, new_dir(spark, "board"), stateful.schema_of(stateful.BOARD), "job")
    run = lambda rows, log: stateful.drain(stateful.job_board(rows, BOARD_CAP, BOARD_AGE, shards=8), log, write=stateful.board_into(jobs), mode="update")
    stateful.replay(spark, e, stateful.spans(e, "ts", PARTS), run)
    return stateful.board(jobs, BOARD_CAP).select(F.col("job").alias("event_id"), "status")

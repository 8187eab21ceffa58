"""What streams keep by key between batches: course memory and the board of jobs (in keyed tables), log tails and heartbeats (in state).

Each keeps what its key needs and no more, and its output does not depend on how rows are cut into batches, as
long as the rows of a key arrive in order: what a timer would say at the end of a batch is said at the key's next
row instead, if that comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import DataType, StructType

from scriptorium.operators.context import KEEP_FULL, KEEP_SYMBOLS
from scriptorium.operators.jobs import CAP, FINISHED, HEARTBEAT_CAP
from scriptorium.session import discard, materialize, new_dir, setting
from scriptorium.streaming.tables import KeyedTable, last_of

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The mark after a finished job's last line.
END = "[FINE]"


def drain(out: DataFrame, log: str, write: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that is there, from where its checkpoint stands: into a function of batches or a folder of files."""
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    with setting(out.sparkSession, STORE, ROCKS):
        q = writer.foreachBatch(write).start() if write else writer.format("parquet").option("path", path).start()
        q.awaitTermination()
    return q


def replay(spark: SparkSession, rows: DataFrame, parts: list[Column], run: Callable[[DataFrame, str], StreamingQuery]) -> list[StreamingQuery]:
    """Rows that arrive part by part; after each, run(stream, log) goes on from its checkpoint, as after a restart."""
    folder, log = new_dir(spark, "arrivals"), new_dir(spark, "log")
    queries = []
    for part in parts:
        rows.where(part).write.mode("append").parquet(folder)
        queries.append(run(spark.readStream.schema(rows.schema).parquet(folder), log))
    return queries


def spans(rows: DataFrame, time: str, n: int) -> list[Column]:
    """Conditions that cut rows into n parts by equal spans of time; rows without a time come first."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    if low is None:
        return [F.lit(True)]
    cuts = [low + (high - low) * k / n for k in range(1, n)]
    at = F.coalesce(sum((F.when(F.col(time) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(0))
    return [at == k for k in range(n)]


def timed(rows: DataFrame, late: str) -> DataFrame:
    """Rows with a time, as `ts` for the watermark and as whole milliseconds `ms` for processors."""
    return rows.where(F.col("ts").isNotNull()).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withWatermark("ts", late)


def schema_of(ddl: str) -> StructType:
    return DataType.fromDDL(ddl)


LESSON = "number long, version string, title string, concepts array<string>, definitions array<string>, topic string"
SYMBOL = "symbol string, version string, at int, meaning string, place string"
COURSE = f"course long, lessons array<struct<{LESSON}>>, symbols array<struct<{SYMBOL}>>, next_number long, rest array<struct<{SYMBOL}>>"
#: Rows of one course that come together in arrays at once; beyond that lessons and symbols are summed up before.
COURSE_ROWS = 1000


def course_memory(lessons: DataFrame, keep: int = KEEP_FULL, most: int = KEEP_SYMBOLS) -> DataFrame:
    """Of each row the memory of its course as if it were the only one, for `memory_into` to merge.

    A memory has the lessons of a course by number, its symbols, and the next number. A lesson is replaced by one of the
    same number and a later version. All but the last `keep` lessons lose concepts and definitions. A symbol has its last
    meaning, at the place of its first mention; of all but the `most` symbols of last place (`rest`) the meaning goes and
    the place stays, so that a symbol that is mentioned again is not taken for a new one.
    lessons: course, number, version, title, concepts, definitions, topic, symbols (symbol and meaning); versions sort as
    text. Rows without a number say nothing but their course; without a version a meaning is none.
    """
    version, known = F.col("version"), F.col("number").isNotNull()
    lesson = F.struct("number", "version", "title", "concepts", "definitions", "topic")
    said = lambda s, i: F.struct(s.symbol.alias("symbol"), version.alias("version"), i.alias("at"), F.when(version.isNotNull(), s.meaning).alias("meaning"), version.alias("place"))
    return lessons.select(
        "course", F.when(known, F.array(lesson)).alias("lessons"), F.when(known, F.transform("symbols", said)).alias("symbols"), (F.coalesce("number", F.lit(0)) + 1).alias("next_number"),
        F.lit(None).cast(schema_of(COURSE)["rest"].dataType).alias("rest"), F.lit(keep).alias("keep"), F.lit(most).alias("most"),
    )


def summed(memories: DataFrame) -> DataFrame:
    """One memory of each course, without limits: lessons and symbols are summed up by themselves, so that a course's rows need not come together."""
    lessons = memories.select("course", F.explode("lessons").alias("x")).groupBy("course", "x.number").agg(F.max("x").alias("lesson"))
    symbols = memories.select("course", F.explode("symbols").alias("x")).unionByName(memories.select("course", F.explode("rest").alias("x")))
    symbols = symbols.groupBy("course", F.col("x.symbol").alias("name")).agg(F.max("x").alias("x"), F.min("x.place").alias("place"))
    symbols = symbols.select("course", F.col("x").withField("place", F.col("place")).alias("symbol"))
    rows = lessons.select("course", "lesson").unionByName(symbols, True).unionByName(memories.select("course").distinct(), True)
    return rows.groupBy("course").agg(F.collect_list("lesson").alias("lessons"), F.collect_list("symbol").alias("symbols")).withColumn("rest", F.lit(None).cast(memories.schema["rest"].dataType))


def merged(memories: DataFrame, keep: int, most: int) -> DataFrame:
    """One memory of each course; of rows of a lesson with the same version the greatest stays."""
    rows = memories.groupBy("course").count().agg(F.max("count")).first()[0]
    if rows and rows > COURSE_ROWS:
        memories = summed(memories)
    other = lambda xs, x, i, by: ~x[by].eqNullSafe(F.get(xs, i)[by])
    last = lambda xs, by: F.filter(xs, lambda x, i: (i == F.size(xs) - 1) | other(xs, x, i + 1, by))
    first = lambda xs, by: F.filter(xs, lambda x, i: (i == 0) | other(xs, x, i - 1, by))
    all_of = lambda *names: F.sort_array(F.flatten(F.concat(*[F.collect_list(c) for c in names])))
    rows = memories.groupBy("course").agg(all_of("lessons").alias("lessons"), all_of("symbols", "rest").alias("symbols"))
    places = F.transform("symbols", lambda x: F.struct(x.symbol.alias("symbol"), x.place.isNull().alias("none"), x.place.alias("place")))
    rows = rows.withColumn("places", F.sort_array(places))
    placed = lambda x, p: F.struct(p.place.alias("place"), x.withField("place", p.place).alias("x"))
    named = F.zip_with(last(F.col("symbols"), "symbol"), first(F.col("places"), "symbol"), placed)
    rows = rows.select("course", last(F.col("lessons"), "number").alias("lessons"), F.sort_array(named).alias("named"))
    full, over = F.size("lessons") - keep, F.greatest(F.size("named") - most, F.lit(0))
    cut = lambda x, i: x.withField("concepts", F.when(i >= full, x.concepts)).withField("definitions", F.when(i >= full, x.definitions))
    return rows.select(
        "course", F.transform("lessons", cut).alias("lessons"), F.transform(F.slice("named", over + 1, F.lit(most)), lambda n: n.x).alias("symbols"),
        (F.coalesce(F.get("lessons", F.size("lessons") - 1)["number"], F.lit(0)) + 1).alias("next_number"),
        F.transform(F.slice("named", F.lit(1), over), lambda n: n.x.withField("meaning", F.lit(None).cast("string"))).alias("rest"),
    )


def memory_into(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """A batch writer: each course's memory of all batches; the limits of a batch hold for all courses of the buckets that it touches."""

    def write(batch: DataFrame, number: int) -> None:
        limits = batch.select("keep", "most").first()
        table.merge(batch, number, lambda rows: merged(rows, *limits))

    return write


class LogTail(StatefulProcessor):
    """Lines of a job's log as a reader gets them: the offset that it stands at afterwards, in characters, and the line.

    Blank lines move the offset only. When a job whose last status is a finished one has been silent for `quiet` seconds of
    event time, the end is marked, by a timer or before the job's next line. Rows: ms, seq, status, line.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "characters long, last long, finished boolean, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        offset, last, finished, ended = self.at.get() or (0, None, False, False)
        if last is not None and finished and not ended:
            self.handle.deleteTimer(last + self.quiet)
        for r in sorted(rows, key=lambda r: (r.ms, r.seq)):
            now = r.ms
            if last is not None and finished and not ended and now - last > self.quiet:
                yield Row(job=key[0], characters=offset, line=END)
            line = r.line or ""
            offset += len(line) + 1
            last, finished, ended = now, r.status in FINISHED, False
            if line.strip():
                yield Row(job=key[0], characters=offset, line=line.rstrip())
        if finished:
            self.handle.registerTimer(last + self.quiet)
        self.at.update((offset, last, finished, ended))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        offset, last, finished, ended = self.at.get()
        if finished and not ended:
            self.at.update((offset, last, True, True))
            yield Row(job=key[0], characters=offset, line=END)

    def close(self) -> None:
        pass


def log_tail(lines: DataFrame, quiet: int, late: str = "0 seconds") -> DataFrame:
    """job, characters, line of a stream of (job, ts, seq, status, line); rows without a time are left out, a null line is blank."""
    return timed(lines, late).groupBy("job").transformWithState(LogTail(quiet), "job long, characters long, line string", "Append", "EventTime")


class Heartbeat(StatefulProcessor):
    """Progress of a running step every `every` seconds of event time until the job's next event, without any row of its own.

    Progress goes from `low` to `high` by the share of `estimate` that has passed, 95 % of the way at most; a step that
    runs longer than `limit` seconds beats no more. Timers say what is due when the watermark has passed; a job's
    next event says first what was due before it. Rows: ms, seq, status.
    """

    def __init__(self, every: int, estimate: float, limit: int, low: int, high: int):
        self.every, self.estimate, self.limit, self.low, self.high = every * 1000, estimate, limit * 1000, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.step = handle.getValueState("step", "began long, said long")

    def beats(self, job: int, began: int, said: int, until: int) -> Iterator[Row]:
        """Beats after `said` and before `until`."""
        t = said + self.every
        while t < until and t - began <= self.limit:
            passed = (t - began) / 1000
            share = min(passed / self.estimate, HEARTBEAT_CAP)
            yield Row(job=job, at=t, progress=int(self.low + share * (self.high - self.low)), passed=int(passed))
            t += self.every

    def due(self, began: int, said: int) -> int | None:
        return said + self.every if said + self.every - began <= self.limit else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        began, said = self.step.get() or (None, None)
        if began is not None and (due := self.due(began, said)):
            self.handle.deleteTimer(due)
        for r in sorted(rows, key=lambda r: (r.ms, r.seq)):
            now = r.ms
            if began is not None:
                yield from self.beats(key[0], began, said, now)
            began, said = (now, now) if r.status == "running" else (None, None)
        if began is None:
            self.step.clear()
        else:
            self.step.update((began, said))
            if due := self.due(began, said):
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        began, said = self.step.get()
        until = timerValues.getCurrentWatermarkInMs()
        last = said
        for beat in self.beats(key[0], began, said, until):
            last = beat.at
            yield beat
        if last != said:
            self.step.update((began, last))
        if due := self.due(began, last):
            self.handle.registerTimer(max(due, until + 1) if due <= until else due)

    def close(self) -> None:
        pass


def heartbeats(steps: DataFrame, every: int = 15, estimate: float = 600.0, limit: int = 600, low: int = 10, high: int = 40, late: str = "0 seconds") -> DataFrame:
    """job, at, progress, passed (seconds) of a stream of (job, ts, seq, status); rows without a time are left out."""
    rows = timed(steps, late).groupBy("job")
    out = rows.transformWithState(Heartbeat(every, estimate, limit, low, high), "job long, at long, progress int, passed int", "Append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))


BOARD = "job long, status string, created long, kept boolean, said long"


def job_board(jobs: DataFrame, cap: int = CAP, age: int | None = None, shards: int = 64, late: str = "0 seconds") -> DataFrame:
    """A stream of (job, ts, status) with the limits of its board, for `board_into` to hold against the board's table.

    age: seconds that a finished job stays, counted to the watermark. shards has no effect any more: jobs are dealt as
    Spark deals the groups of an aggregate.
    """
    lag = F.expr(f"unix_millis(timestamp_seconds(0) + interval '{late}')")
    limits = [F.lit(cap).alias("cap"), F.lit(None if age is None else age * 1000).cast("long").alias("age"), lag.alias("late")]
    return timed(jobs, late).select("job", "status", "ts", "ms", *limits)


def is_finished() -> Column:
    return F.coalesce(F.col("status").isin(*FINISHED), F.lit(False))


def board_into(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """A batch writer: the table has the jobs that may have to be shown, active ones and the `cap` finished ones created last.

    The last row of a job by time counts (a finished one of those at one time). Where finished jobs age, those too far
    behind the watermark go, and rows at it or behind it are left out; it is `late` behind the last row of the board and
    the batch. The times of a batch are summed up by job, as numbers alone; only jobs that stay are looked up for their
    status, and only those that change, or go, are merged.
    """

    def write(batch: DataFrame, number: int) -> None:
        limits = batch.select("cap", "age", "late").first()
        if limits is None:
            return
        cap, age, late = limits
        old = table.read().select("job", "status", "created")
        before = None if age is None else old.agg(F.max("created")).first()[0]
        if before is not None:
            batch = batch.where(F.col("ts") > F.timestamp_millis(F.lit(before - late)))
        rows = batch.select("job", "status", "ts").unionByName(old.select("job", "status", F.timestamp_millis("created").alias("ts")))
        times = rows.groupBy("job").agg(F.max(F.when(is_finished(), F.col("ts"))).alias("end"), F.max(F.when(~is_finished(), F.col("ts"))).alias("begin"))
        ended, created = F.coalesce(F.col("end") >= F.col("begin"), F.col("begin").isNull()), F.unix_millis("ts")
        last = times.select("job", ended.alias("ended"), F.greatest("end", "begin").alias("ts"))
        if age is not None:
            reached = max(t for t in (before, batch.agg(F.max("ms")).first()[0]) if t is not None)
            last = last.where(~F.col("ended") | (created >= reached - late - age))
        last = materialize(last, "last")
        newest = last.where("ended").orderBy(created.desc(), F.col("job").desc()).limit(cap)
        stays = materialize(last.where("not ended").unionByName(newest), "stays")
        of = F.col("s.job").eqNullSafe(F.col("r.job")) & (F.col("s.ts") == F.col("r.ts"))
        found = stays.alias("s").join(rows.withColumn("ended", is_finished()).alias("r"), of & (F.col("s.ended") == F.col("r.ended")))
        now = found.groupBy(F.col("s.job").alias("job"), F.unix_millis("s.ts").alias("created")).agg(F.max("r.status").alias("status"))
        now = materialize(now.select("job", "status", "created"), "shown")
        here = F.col("n.job").eqNullSafe(F.col("o.job"))
        same = here & F.col("n.status").eqNullSafe(F.col("o.status")) & (F.col("n.created") == F.col("o.created"))
        comes = now.alias("n").join(old.alias("o"), same, "left_anti").withColumn("kept", F.lit(True))
        goes = old.alias("o").join(now.alias("n"), here, "left_anti").withColumn("kept", F.lit(False))
        table.merge(comes.unionByName(goes).withColumn("said", F.lit(number).cast("long")), number, lambda r: last_of("job", ["said"])(r).where("kept"))
        discard(last, stays, now)

    return write


def board(table: KeyedTable, cap: int = CAP) -> DataFrame:
    """What is shown: all active jobs, and the newest finished ones that they leave room for."""
    rows = table.read()
    finished = is_finished()
    room = max(0, cap - rows.where(~finished).count())
    return rows.where(~finished).unionByName(rows.where(finished).orderBy(F.col("created").desc(), F.col("job").desc()).limit(room)).select("job", "status", "created")

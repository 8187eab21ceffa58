"""Streaming forms: keyed latest state, expiry, and windows and sessions with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from scriptorium.session import new_dir
from scriptorium.streaming.stateful import drain
from scriptorium.streaming.tables import KeyedTable

LAG = "1 day"


def source(spark: SparkSession, path: str, schema: StructType | None = None, files_at_once: int = 64) -> DataFrame:
    """A stream of the parquet files of a path, as they arrive; progress is kept in the query's checkpoint.

    A file source watches folders, so a path to a single file is watched by its name in its folder.
    """
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    folder, _, name = path.rstrip("/").rpartition("/")
    probe = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(probe).isFile()
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def daily(events: DataFrame) -> DataFrame:
    """Counts and sums by day and type; as a stream, days close when the watermark has passed."""
    d = events.withWatermark("ts", LAG) if events.isStreaming else events
    return d.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest_by_stream(spark: SparkSession, path: str) -> DataFrame:
    """user_id, event_type, last_error of a stream of events, once all that is there has been read."""
    events = source(spark, path).select("user_id", "ts", "event_id", "event_type")
    errors = F.max(F.when(F.col("event_type") == "error", F.col("event_id")))
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    told = lambda rows: rows.groupBy("user_id").agg(last, errors.alias("last_error"))
    schema = told(spark.createDataFrame([], events.schema)).schema
    table = KeyedTable(spark, new_dir(spark, "latest"), schema, "user_id")
    combine = lambda rows: rows.groupBy("user_id").agg(F.max("last").alias("last"), F.max("last_error").alias("last_error"))
    drain(events, new_dir(spark, "log"), write=lambda batch, number: table.merge(told(batch), number, combine))
    return table.read().select("user_id", F.col("last.event_type").alias("event_type"), "last_error")


def sessions(rows: DataFrame, key: str, gap: str, late: str = LAG) -> DataFrame:
    """key, start, end, n, first, last: runs of a key's rows with less than `gap` between them.

    As a stream, a session is given once the watermark has passed its end; a row that comes when its own session would have
    closed is late and counted as dropped in the query's progress. Rows out of order, but in time, join the sessions that
    they belong to, and sessions that they bridge become one. rows: key, ts, seq.
    """
    d = rows.withWatermark("ts", late) if rows.isStreaming else rows
    g = d.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "first", "last")


def dropped(queries: list[StreamingQuery]) -> int:
    """Rows that came after the watermark had passed them, by the progress of queries."""
    return sum(s["numRowsDroppedByWatermark"] for q in queries for p in q.recentProgress for s in p["stateOperators"])


def tail(lines: DataFrame, job: str, text: str) -> DataFrame:
    """Lines of logs that are not blank; `stateful.log_tail` also says where a reader stands and when a log ends."""
    return lines.where(F.trim(text) != "").select(job, text)


def expire(events: DataFrame, key: str) -> DataFrame:
    """A stream's distinct keys within the watermark; older state goes."""
    return events.withWatermark("ts", LAG).dropDuplicatesWithinWatermark([key])

"""Job tables: latest state, admission, eviction, expiry, recovery, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP, ACTIVE, FINISHED = 200, ("queued", "running"), ("done", "error")
HEARTBEAT_CAP = 0.95


def latest_state(log: DataFrame, job: str, order: list[str]) -> DataFrame:
    """The last event of each job: a partial aggregate, not a sort."""
    rest = [c for c in log.columns if c != job]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(job).agg(last.alias("s")).select(job, *[F.col(f"s.{c}").alias(c) for c in rest])


def reload(jobs: DataFrame, status: str = "status", drop: tuple[str, ...] = ("stdout", "stderr")) -> DataFrame:
    """Jobs as stored and read again: without long outputs; what was running has failed."""
    return jobs.drop(*drop).withColumn(status, F.when(F.col(status) == "running", "error").otherwise(F.col(status)))


def evict(jobs: DataFrame, status: str, created: list[str], cap: int = CAP) -> DataFrame:
    """At most `cap` jobs: the oldest finished ones go, active ones never. The active ones leave room for `cap` finished
    ones at most, so the newest of these are taken, however many jobs there are; a null time counts as oldest."""
    finished = F.coalesce(F.col(status).isin(*FINISHED), F.lit(False))
    room = max(0, cap - jobs.where(~finished).count())
    return jobs.where(~finished).unionByName(jobs.where(finished).orderBy(*[F.col(c).desc() for c in created]).limit(room))


def expired(status: Column, modified: Column, now: Column, days: Column) -> Column:
    """Finished and older than so many days."""
    return status.isin(*FINISHED) & (modified < now - F.make_dt_interval(days))


def admits(jobs: DataFrame, by: list[str], status: str, most: int) -> DataFrame:
    """running and admitted for each key: queued jobs do not count."""
    g = jobs.groupBy(*by).agg(F.count_if(F.col(status) == "running").alias("running"))
    return g.withColumn("admitted", F.col("running") < most)


def orphans(outputs: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Outputs without a job, as finished jobs with stand-in titles."""
    return outputs.join(jobs.select(key), key, "left_anti").withColumn("title", F.coalesce("title", F.col(key).cast("string"))).withColumn("status", F.lit("done"))


def status_view(jobs: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    """Jobs with their latest progress, which counts while they run and when they are done; else the status gives the step."""
    live = F.col("status").isin("running", "done")
    d = jobs.join(progress.withColumnsRenamed({"progress": "_p", "current_step": "_s"}), key, "left")
    step = F.when(F.col("status") == "done", "Completato").when(F.col("status") == "queued", "In coda").when(F.col("status") == "error", "Errore").otherwise("")
    done = F.when(F.col("status") == "done", 100).otherwise(0)
    return d.withColumns({"progress": F.coalesce(F.when(live, F.col("_p")), done), "current_step": F.coalesce(F.when(live, F.col("_s")), step)}).drop("_p", "_s")


def listing(jobs: DataFrame, done_only: bool = False) -> DataFrame:
    d = jobs.where(F.col("status") == "done") if done_only else jobs
    return d.orderBy(F.col("created_at").desc())


def heartbeat(base: Column, end: Column, elapsed: Column, estimate: Column) -> Column:
    """Progress while a step runs: up to 95 % of its span."""
    return base + F.least(elapsed / estimate, F.lit(HEARTBEAT_CAP)) * (end - base)


def clamp_progress(p: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), p))


def delete(jobs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return jobs.join(ids, key, "left_anti")


def retry_wait(attempt: Column, code: Column, most: int = 3) -> Column:
    """Seconds before the next attempt of a remote call, null where there is none."""
    return F.when(code.isin(429, 529) & (attempt < most), 20 * attempt)


def to_boolean(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("true", "1", "yes"), F.lit(False))


def known_or_null(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value)


def positive_or_null(value: Column) -> Column:
    return F.when(value.rlike("^[0-9]+$") & (value.try_cast("int") > 0), value.try_cast("int"))


def guarded(value: Column, low: int, high: int, before: Column) -> Column:
    """A setting's new value where it is a whole number within bounds, else the one before."""
    n = value.try_cast("int")
    return F.coalesce(F.when(n.between(low, high), n), before)


def split_errors(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Results and the dead-letter rows."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def ring(log: DataFrame, key: str, order: list[Column], most: int = 500) -> DataFrame:
    return log.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def role_report(sources: DataFrame, by: list[str], text: str) -> DataFrame:
    """Sources and characters for each key, with subtotals."""
    return sources.rollup(*by).agg(F.count("*").alias("n_sources"), F.sum(F.length(text)).alias("n_chars"))

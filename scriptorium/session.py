"""Session helpers: tables, shared storage, and making the package visible to executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch where the session does not say: texts are long, and a worker holds a batch at a time.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: With this Spark deletes the shuffle files of a finished write, instead of when the driver's JVM collects its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.getAll.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application (needed where executors lack the repository)."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    path = os.path.join(tempfile.mkdtemp(), f"{_ROOT.name}.zip")
    Path(path).write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and the master is local."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scriptorium-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below the scratch folder of the code that runs."""
    return f"{(_scratch.get() or shared_dir(spark)).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A folder for all tables that the code within writes below the shared one; it goes with them at the end."""
    root = new_dir(spark, "scratch")
    token = _scratch.set(root)
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, root)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from any store that Spark writes; nothing happens where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df._written)

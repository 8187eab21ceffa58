"""Keyed tables that streams write: copy-on-write of the buckets that a batch touches, committed by a manifest.

    <path>/data/<batch>/bucket=<b>/...   rows of a bucket as the batch left them
    <path>/manifest/<batch>.json         the batch that wrote each bucket last

A row lies in the bucket of its key's hash. A merge reads the buckets with a key of the batch, combines their rows
with those of the batch, writes these buckets anew and renames a manifest into place, which commits them at once: a
reader sees a batch whole or not at all. What a batch writes is in proportion to the buckets that it touches, so a table has
the more buckets the larger it is. Data that no kept manifest names is removed after the commit; one manifest before the
last is kept for readers that have begun. A batch that is given again after a failure is known by its number.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.session import delete, discard, materialize

BUCKETS = 64
#: Manifests that stay.
KEPT = 2
Combine = Callable[[DataFrame], DataFrame]


def last_of(key: str, order: list[str]) -> Combine:
    """The last row of each key."""

    def combine(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
        return last.select(key, *[F.col(f"_s.{c}").alias(c) for c in rest])

    return combine


@dataclass(frozen=True)
class KeyedTable:
    """A table of rows by key; schema: its columns, the key among them."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = BUCKETS

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def batches(self) -> list[int]:
        """Numbers of the committed batches that are kept, ascending."""
        fs, folder = self._fs(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, batch: int | None = None) -> dict[int, int]:
        """Bucket to the batch that wrote it, as of a batch (the last, if not said)."""
        done = self.batches()
        if not done:
            return {}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{done[-1] if batch is None else batch:09d}.json").first()[0]
        return {int(b): n for b, n in json.loads(text).items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, where: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{n}/bucket={b}" for b, n in sorted(where.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def merge(self, rows: DataFrame, batch: int, combine: Combine) -> None:
        """combine: of all rows of the touched keys, old and new, those that stay (keys may go)."""
        done = self.batches()
        if done and batch <= done[-1]:
            return
        before = self.manifest()
        rows = materialize(rows.select(*self.schema.names), "batch")  # read twice, but told once
        touched = sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # as many as buckets at most
        if touched:
            old = self._rows({b: before[b] for b in touched if b in before})
            new = combine(old.unionByName(rows)).withColumn("bucket", self.bucket())
            new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch}")
        left = [b for b in touched if self._exists(f"{self.path}/data/{batch}/bucket={b}")]
        after = {b: n for b, n in before.items() if b not in touched} | dict.fromkeys(left, batch)
        self._commit(batch, after)
        self._sweep([*done, batch])
        discard(rows)

    def _commit(self, batch: int, where: dict[int, int]) -> None:
        fs, folder = self._fs(f"{self.path}/manifest")
        fs.mkdirs(folder)
        _, draft = self._fs(f"{self.path}/manifest/.{batch:09d}.draft")
        _, final = self._fs(f"{self.path}/manifest/{batch:09d}.json")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(where).encode()))
        finally:
            out.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"{final} could not be committed")

    def _sweep(self, done: list[int]) -> None:
        """Remove manifests but the last, and buckets that only removed ones name."""
        gone, kept = done[:-KEPT], done[-KEPT:]
        named = {x for n in kept for x in self.manifest(n).items()}
        for n in gone:
            for b, wrote in self.manifest(n).items():
                if (b, wrote) not in named:
                    delete(self.spark, f"{self.path}/data/{wrote}/bucket={b}")
            delete(self.spark, f"{self.path}/manifest/{n:09d}.json")

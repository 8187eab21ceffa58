"""Bounded samples of rows by group: of each group the rows whose digest is least, copies once.

Digests of copies are equal and those of unlike rows are not, so ids that are null or shared neither thin a sample out
nor swell it. Counts of distinct digests tell below which share of all digests enough lie; what lies there,
about twice the rows wanted, is written, and ranked within the group. So no task ranks a whole group, and a sample
has exactly the rows it may have at most, where the group has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import materialize

_MOST = (1 << 63) - 1


def digest(salt: str, *columns: str) -> Column:
    """63 bits of a row's contents, the same in every run."""
    return F.xxhash64(F.lit(salt), *columns).bitwiseAND(F.lit(_MOST))


def distinct_rows(rows: DataFrame, group: str) -> DataFrame:
    """group, n: about how many digests the rows of each group have."""
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.approx_count_distinct("digest").alias("n"))


def least(rows: DataFrame, group: str, wanted: dict[object, tuple[int, int]]) -> DataFrame:
    """Rows of least digest, one for each digest. rows: with `digest`; wanted: by group how many digests there are, and how many rows to take."""
    spark, kind = rows.sparkSession, rows.schema[group].dataType.simpleString()
    bounds = [(g, _MOST if n <= 2 * most else _MOST // n * 2 * most, most) for g, (n, most) in wanted.items()]
    below = spark.createDataFrame(bounds, f"{group} {kind}, _below long, _most int")
    few = rows.join(F.broadcast(below), group).where("digest <= _below").dropDuplicates([group, "digest"])  # a row for each group
    few = materialize(few, "candidates")
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("digest")))
    return ranked.where("_rank <= _most").drop("_below", "_most", "_rank")

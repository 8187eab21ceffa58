"""Subjects by registered profiles of any size: one automaton over all keywords reads a text once.

A keyword counts for its profile if the lower-cased text contains it, once however often it does. Profiles are a table
(profile, rank, keyword); their keywords are dealt into shards of about SHARD characters, each of which is broadcast as an
automaton in its turn, so memory has a bound whatever is registered, and a text is read as often as there are shards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from scriptorium.operators.classify import GENERIC
from scriptorium.session import ship

#: Characters of keywords of an automaton, some hundred bytes of memory each, and keywords that a profile needs.
SHARD, LEAST = 2_000_000, 2
SCORES = "array<struct<score:bigint,rank:bigint,profile:string>>"


def registered(profiles: DataFrame) -> DataFrame:
    """profile, rank, keyword: distinct lower-cased keywords that are not empty, under the least rank of their profile."""
    low = profiles.select("profile", F.col("rank").cast("long").alias("rank"), F.lower("keyword").alias("keyword")).where("profile is not null and keyword <> ''")
    ranks = low.groupBy("profile").agg(F.min("rank").alias("rank"))
    return low.select("profile", "keyword").distinct().join(ranks, "profile").select("profile", "rank", "keyword")


def scores(docs: DataFrame, text: str, profiles: DataFrame, shard: int = SHARD) -> DataFrame:
    """docs with `scores`: how many keywords of each profile the text contains, profiles without any left out.

    A null text contains nothing; each row is scored by itself, repeated ones too.
    """
    spark = docs.sparkSession
    ship(spark)
    words = registered(profiles)
    total = words.agg(F.sum(F.length("keyword"))).first()[0] or 0
    n = max(1, -(-total // shard))
    rest = [c for c in docs.columns if c != "scores"]
    rows = docs.select(*rest, F.lower(text).alias("_text"), F.lit(None).cast(SCORES).alias("scores"))
    for k in range(n):
        part = words.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == k).toArrow()
        rows = rows.mapInArrow(_reader(spark.sparkContext.broadcast(part)), rows.schema)
    return rows.drop("_text")


def _reader(shared):
    """Adds to scores what the keywords of one shard find."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, ranks, owners = ahocorasick.Automaton(), {}, {}
        for profile, rank, word in zip(*(c.to_pylist() for c in shared.value.columns), strict=True):
            owners.setdefault(word, []).append(profile)
            ranks[profile] = rank
        for word in owners:
            automaton.add_word(word, word)
        if owners:
            automaton.make_automaton()
        for batch in batches:
            out = []
            for text, before in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                met = {word for _, word in automaton.iter(text)} if owners and text else ()
                told = {s["profile"]: s["rank"] for s in before or ()} | ranks
                count = Counter({s["profile"]: s["score"] for s in before or ()})
                count.update(profile for word in met for profile in owners[word])
                out.append([{"score": n, "rank": told[profile], "profile": profile} for profile, n in sorted(count.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, batch.schema.field(batch.num_columns - 1).type)], names=batch.schema.names)

    return read


def subjects(docs: DataFrame, text: str, profiles: DataFrame, hint: str | None = None, shard: int = SHARD) -> DataFrame:
    """docs with subject and score: the profile with most keywords, at least LEAST; ties go to the least rank, then to the last name.

    A hint that is part of a profile's name, or has it as a part, decides (the profile of least rank, then of first name).
    """
    told = scores(docs, text, profiles, shard)
    best = F.array_max(F.transform("scores", lambda s: F.struct(s.score.alias("score"), (-s.rank).alias("order"), s.profile.alias("profile"))))
    told = told.withColumn("_best", best)
    chosen = F.when(F.col("_best.score") >= LEAST, F.col("_best.profile")).otherwise(F.lit(GENERIC))
    if hint:
        told, chosen = named(told, hint, profiles), F.coalesce(F.col("_named"), chosen)
    return told.withColumns({"subject": chosen, "score": F.coalesce("_best.score", F.lit(0)).cast("long")}).drop("_best", "_named", "scores")


def named(rows: DataFrame, hint: str, profiles: DataFrame) -> DataFrame:
    """rows with `_named`, the profile that a hint names; names are broadcast, a row for each profile, and each hint is looked up once a task."""
    first = registered(profiles).groupBy("profile").agg(F.min("rank").alias("rank")).orderBy("rank", "profile").select("profile", F.lower("profile")).toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(first)
    schema = StructType([*rows.schema.fields]).add("_named", DataType.fromDDL("string"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(zip(*(c.to_pylist() for c in shared.value.columns), strict=True))

        @lru_cache(1 << 14)
        def of(said: str) -> str | None:
            return next((name for name, low in names if low in said or said in low), None)

        for batch in batches:
            said = batch.column(batch.num_columns - 1).to_pylist()
            found = [of(x) if x else None for x in said]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=[*batch.schema.names[:-1], "_named"])

    return rows.select("*", F.lower(hint).alias("_hint")).mapInArrow(look, schema)

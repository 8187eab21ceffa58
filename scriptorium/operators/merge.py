"""Merging of two extractions of the same pages, as outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.pyre import once, told
from scriptorium.functions.text import SPARSE, clean_extracted, density


def pick_denser(first: DataFrame, second: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Of two texts of a page the one with more visible characters per length (ties: the first), cleaned; empty pages go."""
    a, b = first.select(*keys, F.col(text).alias("_a")), second.select(*keys, F.col(text).alias("_b"))
    d = a.join(b, keys, "full_outer").withColumns({"_a": F.coalesce("_a", F.lit("")), "_b": F.coalesce("_b", F.lit(""))})
    better = once(F.regexp_replace("_a", "  +", " "), density) >= density(F.col("_b"))
    d = told(d, "_t", F.when(better, F.col("_a")).otherwise(F.col("_b")))
    d = told(d, text, clean_extracted(F.col("_t")))
    return d.where(F.col(text) != "").select(*keys, text, F.length(text).alias("chars_count"))


def enrich_sparse(pages: DataFrame, other: DataFrame, keys: list[str], text: str, append: bool) -> DataFrame:
    """Pages under SPARSE characters get the other text appended, or replaced by it; missing pages are added."""
    o = other.select(*keys, F.col(text).alias("_o"))
    d = pages.select(*keys, F.col(text).alias("_t")).join(o, keys, "full_outer")
    joined: Column = F.concat_ws("\n", "_t", "_o") if append else F.col("_o")
    new = F.when(F.col("_t").isNull(), F.col("_o")).when((F.length("_t") < SPARSE) & F.col("_o").isNotNull(), joined).otherwise(F.col("_t"))
    return d.withColumn(text, new).select(*keys, text, F.length(text).alias("chars_count"))


def page_union(texts: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Every page that has text or an image."""
    return texts.join(images, keys, "full_outer")


def copies(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key (the least), digest, copies of each distinct content: an aggregate with partial sums, whatever the size of a group."""
    return rows.groupBy(F.md5(content).alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("copies"))

"""Samples of fits: null, shared and unlike ids, copies, and the bounds of what reaches the driver."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import langid, sampling, toxicity

WORDS = {"en": "the of and to in that house water people working thought river mountain", "de": "der die und zu in das haus wasser leute arbeit gedanke fluss gebirge"}


def talk(lang, rng):
    return " ".join(rng.choices(WORDS[lang].split(), k=30))


@pytest.mark.parametrize("ids", ["unlike", "null", "one"])
def test_language_learns_whatever_the_ids(spark, ids):
    rng = random.Random(3)
    rows = [({"unlike": k, "null": None, "one": 5}[ids], talk(lang, rng), lang) for k in range(1500) for lang in ("en", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    limits = langid.Limits(100, 150, 256)
    took = Counter(r["lang"] for r in langid.sampled(docs, limits).collect())
    assert took == {"en": 75, "de": 75}
    got = langid.predict(docs, langid.fit(docs, limits)).select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.99 * len(rows)


def test_copies_teach_once(spark):
    rows = [(None, "only one text here", "en")] * 2000 + [(k, "et un autre texte", "fr") for k in range(40)] + [(1, None, "en"), (1, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert Counter(r["lang"] for r in langid.sampled(docs, langid.Limits(20, 100, 9)).collect()) == {"en": 1, "fr": 20}
    assert langid.sampled(docs.limit(0)).collect() == []


@pytest.mark.parametrize("shared", [True, False])
def test_toxicity_sample_is_bounded(spark, shared):
    rng = random.Random(4)
    texts = [(7 if shared else k, f"{talk('en', rng)} {k}") for k in range(3000)] + [(100_000 + k, f"insult {talk('de', rng)}") for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = spark.createDataFrame([(i, int(i >= 100_000)) for i in sorted({i for i, _ in texts})], "doc_id long, label int")
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    took = Counter(r["label"] for r in toxicity.sampled(docs, one, counts, toxicity.Limits(10, 20, 300)).collect())
    assert took[1] <= 10 and took[0] <= 20 and (not shared or took[0] == 20)
    model = toxicity.fit(docs, one, "label", lambda i: F.lit(True), toxicity.Limits(40, 60, 300))
    got = toxicity.score_documents(docs, model, 0.5).collect()
    assert sum(r["predicted"] == (r["doc_id"] >= 100_000) for r in got) > 0.95 * len(got)


def test_least_hashes(spark):
    rows = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 1000).alias("x")).withColumn("digest", sampling.digest("s", "x"))
    n = sampling.distinct_rows(rows, "g").first()["n"]
    got = [r["x"] for r in sampling.least(rows, "g", {"a": (n, 50)}).collect()]
    want = [r["x"] for r in rows.select("x", "digest").distinct().orderBy("digest").limit(50).collect()]
    assert sorted(got) == sorted(want)


def test_the_pipeline_keeps_documents_without_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.lit(None).cast("long"))
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.count() >= 0.95 * docs.count()

"""A corpus pipeline of five stages over `documents`; each stage's result is written and read again by the next.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, langid, ngram_join, packing, secrets
from scriptorium.llm.tokens import default_tokenizer
from scriptorium.session import delete, new_dir, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which no language can be told (without a letter) go; a null `lang` becomes the predicted one."""
    model = langid.fit(docs.where(~langid.held_out_quarter(F.col("doc_id"))))
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    told = langid.predict(docs.select(rest, "text"), model).where(F.col("lang_pred") != langid.UND)
    filled = told.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")))
    return filled.select(*[F.col(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared five-word sequences the one of least doc_id stays."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(docs, default_tokenizer(), end_id=2, capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learned models, tokens and packings are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage has written for itself, and the stage before it, goes when it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs

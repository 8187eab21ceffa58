"""The library path: three texts of a lesson to one normalised record and its prompt.

Everything is column expressions over one row for each lesson, but two steps that work on rows: deduplicating
paragraphs and cutting into sections. Texts are cleaned once and written, as the branches of the plan all read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.pyre import strip, told
from scriptorium.operators import classify, render, sequence
from scriptorium.session import materialize


def normalize(lessons: DataFrame, key: str, forced_mode: str | None = None) -> DataFrame:
    """lessons: key, title, transcript, slides, extra, hint, context. Adds subject, mode, tokens, sections, formulas, prompt."""
    names = {"transcript": "tr", "slides": "sl", "extra": "ex"}
    d = lessons.select(key, "title", "hint", "context", *names)
    for text, clean in names.items():
        d = told(d, clean, F.when(F.coalesce(F.col(text), F.lit("")) != "", T.clean(F.col(text))).otherwise(F.lit("")))
    d = d.withColumn("subject", classify.subject(classify.sample(F.col("sl"), F.col("tr")), F.col("hint")))
    part = lambda tag, c: F.when(F.col(c) != "", F.concat(F.lit(f"[{tag}]\n"), F.col(c)))
    d = d.withColumn("raw", F.array_join(F.array_compact(F.array(part("SLIDE", "sl"), part("TRASCRIZIONE", "tr"), part("DOCUMENTI", "ex"))), "\n\n"))
    d = materialize(sequence.extract_math(d.withColumn("body", F.col("raw")), "body"), "lessons")  # four branches read it
    paragraphs = sequence.explode_lines(d, key, "body", "\n\n").where(strip(F.col("line")) != "")
    kept = sequence.dedup_first(paragraphs, [key], "pos", "line")
    whole = materialize(sequence.implode(kept, key, "pos", "line", "clean_text", "\n\n"), "whole")
    rows = sequence.explode_lines(whole, key, "clean_text")
    parts = sequence.parse_sections(rows, key, "pos", "line")
    body = F.transform(F.array_sort(F.collect_list(F.struct("sid", F.coalesce("heading", F.lit("")).alias("heading"), "body"))), lambda s: F.struct(s.heading.alias("heading"), s.body.alias("body")))
    sections = parts.groupBy(key).agg(body.alias("sections"))
    out = d.join(whole, key, "left").join(sections, key, "left")
    none = F.expr("cast(array() as array<struct<heading:string,body:string>>)")
    out = out.withColumns({"clean_text": F.coalesce("clean_text", F.lit("")), "sections": F.coalesce("sections", none)})
    out = out.withColumn("tokens", T.token_estimate(F.col("clean_text")))
    out = out.withColumn("mode", T.compression_mode(F.col("tokens"), F.lit(forced_mode) if forced_mode else None))
    aligned = _aligned(out, key)
    out = out.join(aligned, key, "left").withColumn("aligned", F.coalesce("aligned", F.lit("")))
    return out.withColumn("prompt", render.prompt(F.coalesce("context", F.lit("")), F.concat(F.lit("TIPO DI CORSO: "), F.col("subject")), F.col("aligned"), F.col("mode"), F.col("title"), F.col("sections"), F.col("formulas"))).drop("tr", "sl", "ex", "body")


def _aligned(d: DataFrame, key: str) -> DataFrame:
    """key, aligned: the raw transcript held against the raw slides, where both are there."""
    both = d.where(F.col("slides").rlike(r"(?iU)---\s*SLIDE\s*\d+") & (strip(F.coalesce("transcript", F.lit(""))) != ""))
    slides = sequence.parse_slides(both, key, F.col("slides"))
    n = slides.groupBy(key).agg(F.count("*").alias("n"))
    timed = sequence.parse_transcript(both, key, F.col("transcript")).join(n, key)
    timed = sequence.align_timed(timed, key, ["seq"], "time_sec", F.col("n")).select(key, "seq", "time_sec", "text", "idx")
    plain = both.join(timed.select(key).distinct(), key, "left_anti")
    rows = sequence.explode_lines(plain, key, "transcript").withColumn("line", strip(F.col("line"))).where("line <> ''").join(n, key)
    rows = sequence.align_uniform(rows, key, ["pos"], F.col("n")).select(key, F.col("pos").alias("seq"), F.lit(-1).alias("time_sec"), F.col("line").alias("text"), "idx")
    blocks = sequence.aligned_blocks(slides, timed.unionByName(rows), key)
    text = sequence.render_block(F.col("slide_num"), F.col("title"), F.col("body"), F.col("said"))
    return blocks.groupBy(key).agg(render.ordered_join(F.col("slide_pos"), text).alias("aligned"))

"""Memory from lesson to lesson, as tables: upsert, compaction, symbols, rendering, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.pyre import strip

KEEP_FULL, KEEP_SYMBOLS, SHOWN, SHOWN_CONCEPTS = 10, 50, 5, 4
#: Closing headings that are no topic.
CLOSING = r"(?iu)^(note|osservazioni?|conclusioni?|riferimenti|bibliografia|sommario|summary|remark)s?$"
SECTION = r"\\(?:sub)*section\{([^}]+)\}"
ANY_SECTION = r"\\(?:sub)*section\*?\{([^}]+)\}"
DEFINITION = r"\\begin\{definition\}(?:\[([^\]]*)\])?([\s\S]*?)\\end\{definition\}"
SYMBOL = r"(?iuU)\$([\\a-zA-Z{}_\^]+)\$\s+(?:è|indica|denota|rappresenta|is|denotes|represents|means|=)\s+([^.,$\n]{5,60})"


def concepts(latex: Column) -> Column:
    titles = F.transform(F.regexp_extract_all(latex, F.lit(SECTION), F.lit(1)), strip)
    return F.slice(F.array_distinct(F.filter(titles, lambda t: (F.length(t) > 3) & ~t.startswith("Lezione"))), 1, 10)


def definitions(latex: Column) -> Column:
    names, bodies = (F.regexp_extract_all(latex, F.lit(DEFINITION), F.lit(g)) for g in (1, 2))
    short = lambda b: F.substring(F.substring(strip(F.regexp_replace(b, r"(?U)\s+", " ")), 1, 80), 1, 40)
    return F.slice(F.array_distinct(F.zip_with(names, bodies, lambda n, b: F.when(n != "", n).otherwise(short(b)))), 1, 8)


def symbols(latex: Column) -> Column:
    """array<struct<symbol, meaning>> in order of appearance."""
    names, said = (F.regexp_extract_all(latex, F.lit(SYMBOL), F.lit(g)) for g in (1, 2))
    pairs = F.zip_with(names, said, lambda n, m: F.struct(strip(n).alias("symbol"), strip(m).alias("meaning")))
    return F.filter(pairs, lambda p: F.length(p.symbol) < 20)


def last_topic(latex: Column) -> Column:
    titles = F.transform(F.regexp_extract_all(latex, F.lit(ANY_SECTION), F.lit(1)), strip)
    kept = F.filter(titles, lambda t: ~t.rlike(CLOSING))
    return F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))


def upsert(rows: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """The last version of each key."""
    return rows.withColumn("_v", F.row_number().over(Window.partitionBy(*key).orderBy(*version))).where("_v = 1").drop("_v")


def compact(lessons: DataFrame, course: str, number: str, details: list[str], keep: int = KEEP_FULL) -> DataFrame:
    """All but the last `keep` lessons of a course lose their details."""
    d = lessons.withColumn("_r", F.row_number().over(Window.partitionBy(course).orderBy(F.col(number).desc())))
    return d.withColumns({c: F.when(F.col("_r") <= keep, F.col(c)) for c in details}).drop("_r")


def merge_symbols(rows: DataFrame, course: str, symbol: str, meaning: str, order: Column, most: int = KEEP_SYMBOLS) -> DataFrame:
    """course, symbol, meaning, place: each symbol's last meaning at its first place; the last `most` places stay."""
    g = rows.groupBy(course, symbol).agg(F.max_by(meaning, order).alias("meaning"), F.min(order).alias("place"))
    return g.withColumn("_r", F.row_number().over(Window.partitionBy(course).orderBy(F.col("place").desc()))).where(F.col("_r") <= most).drop("_r")


def fill_defaults(title: Column, new_title: Column, subject: Column, new_subject: Column) -> tuple[Column, Column]:
    """A title only where there is none, a subject only in place of the generic one."""
    return F.coalesce(F.nullif(title, F.lit("")), new_title), F.when((subject == "generico") & new_subject.isNotNull(), new_subject).otherwise(subject)


def previous(lessons: DataFrame, course: str, number: str, title: str, concept: str) -> DataFrame:
    """Adds before: the last SHOWN earlier lessons of the course, with up to SHOWN_CONCEPTS concepts each, oldest first.

    A bounded frame before the row: no self-join, and no row holds more than SHOWN earlier ones.
    """
    w = Window.partitionBy(course).orderBy(number).rowsBetween(-SHOWN, -1)
    row = F.struct(F.col(number).alias("number"), F.col(title).alias("title"), F.slice(concept, 1, SHOWN_CONCEPTS).alias("concepts"))
    return lessons.withColumn("before", F.collect_list(row).over(w))


def known(lessons: DataFrame, course: str, number: str, concept: str) -> DataFrame:
    """Adds known: all distinct concepts of earlier lessons in order of first mention.

    Each concept's first mention is an aggregate, so a row gathers what was new in earlier lessons and no repeats.
    """
    each = lessons.select(course, number, F.posexplode_outer(concept).alias("_p", "_c")).where("_c is not null")
    first = each.groupBy(course, "_c").agg(F.min(F.struct(F.col(number).alias("n"), F.col("_p").alias("p"))).alias("_f"))
    new = first.groupBy(course, F.col("_f.n").alias(number)).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_f.p").alias("p"), F.col("_c").alias("c")))), lambda s: s.c).alias("_new"))
    w = Window.partitionBy(course).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return lessons.join(new, [course, number], "left").withColumn("known", F.flatten(F.collect_list("_new").over(w))).drop("_new")


def render(title: Column, prerequisites: Column, notation: Column, before: Column, bridge: Column, concepts_known: Column, defined: Column) -> Column:
    """The context block of a lesson's prompt. before: structs of number, title and concepts; notation: structs of symbol and meaning."""
    line = lambda b: F.concat(F.lit("  Lez. "), b.number.cast("string"), F.lit(": "), F.coalesce(b.title, F.lit("—")), F.when(F.size(b.concepts) > 0, F.concat(F.lit(" → "), F.array_join(F.slice(b.concepts, 1, SHOWN_CONCEPTS), ", "))).otherwise(F.lit("")))
    some = F.size(before) > 0
    last = F.try_element_at(before, F.lit(-1))
    parts = F.array(
        F.lit("## CONTESTO DEL CORSO"),
        F.when(title != "", F.concat(F.lit("Corso: "), title)),
        F.when(F.size(prerequisites) > 0, F.concat(F.lit("Prerequisiti già trattati: "), F.array_join(prerequisites, ", "))),
        F.when(F.size(notation) > 0, F.concat(F.lit("Notazione del corso: "), F.array_join(F.transform(notation, lambda s: F.concat(F.lit("$"), s.symbol, F.lit("$ = "), s.meaning)), ", "))),
        F.when(some, F.concat(F.lit("\nLezioni precedenti:\n"), F.array_join(F.transform(F.slice(before, -F.least(F.size(before), F.lit(SHOWN)), F.lit(SHOWN)), line), "\n"))),
        F.when(some & (bridge != ""), F.concat(F.lit("\n## RACCORDO CON LEZIONE PRECEDENTE\nNella Lezione "), last.number.cast("string"), F.lit(" il professore si è fermato verbalmente su:\n  \""), bridge, F.lit("\""))),
        F.when(some & (F.size(concepts_known) > 0), F.concat(F.lit("\nConcetti già introdotti (NON ri-spiegare da zero): "), F.array_join(concepts_known, ", "))),
        F.when(some & (F.size(defined) > 0), F.concat(F.lit("Definizioni già fornite (non ripetere): "), F.array_join(defined, ", "))),
        F.lit(""),
    )
    return F.array_join(F.array_compact(parts), "\n")


def number_from(start_from: Column, next_number: Column) -> Column:
    """A stated start decides, else the state's next number."""
    return F.coalesce(start_from, next_number, F.lit(1))


def next_number(rows: DataFrame, course: str, number: str) -> DataFrame:
    return rows.groupBy(course).agg((F.max(number) + 1).alias("next_number"))


def previous_chapter(runs: DataFrame, course: str, run: str, lessons: str) -> DataFrame:
    """The largest lesson of the last run of each course."""
    return runs.groupBy(course).agg(F.array_max(F.max_by(lessons, run)).alias("lesson"))


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target, with rows of source whose keys it lacks."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(target.columns))

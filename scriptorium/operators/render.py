"""Prompts and LaTeX files from ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import latex
from scriptorium.functions.pyre import strip
from scriptorium.functions.text import drop_fillers, role_budget, truncate

IMAGES = 20
ROLE_ORDER = ("SCHELETRO", "CARNE", "SUPPORTO", "CONTORNO")


def ordered_join(order: Column, value: Column, sep: str = "\n") -> Column:
    """An aggregate: values joined by order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s.v), sep)


def raw_clean(title: Column, sections: Column) -> Column:
    """sections: array of structs of heading and body."""
    one = lambda s: F.array(F.when(s.heading != "", F.concat(F.lit("\n## "), s.heading)), F.when(s.body != "", s.body))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), title, F.lit("\n"))), F.array_compact(F.flatten(F.transform(sections, one)))), "\n")


def dense(title: Column, sections: Column) -> Column:
    """Without filler lines and the sections that they leave blank."""
    body = lambda s: F.struct(s.heading.alias("heading"), drop_fillers(s.body).alias("body"))
    return raw_clean(title, F.filter(F.transform(sections, body), lambda s: strip(s.body) != ""))


def outline(title: Column, sections: Column, formulas: Column) -> Column:
    def one(s: Column, i: Column) -> Column:
        preview = F.substring(F.array_join(F.slice(F.split(s.body, "\n"), 1, 2), " "), 1, 120)
        head = F.when(s.heading != "", s.heading).otherwise(F.concat(F.lit("Sezione "), (i + 1).cast("string")))
        return F.concat((i + 1).cast("string"), F.lit(". **"), head, F.lit("** — "), preview, F.lit("…"))

    note = F.when(F.size(formulas) > 0, F.array(F.concat(F.lit("\n["), F.size(formulas).cast("string"), F.lit(" formule presenti]")))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# "), title, F.lit(" [OUTLINE]\n"))), F.transform(sections, one), note), "\n")


def prompt(context: Column, instructions: Column, aligned: Column, mode: Column, title: Column, sections: Column, formulas: Column) -> Column:
    """The parts of a prompt that are not blank: aligned text, or the mode's rendering with the formulas."""
    plain = F.when(mode == "OUTLINE", outline(title, sections, formulas)).when(mode == "DENSE", dense(title, sections)).otherwise(raw_clean(title, sections))
    has = aligned != ""
    listed = F.when(~has & (F.size(formulas) > 0), F.concat(F.lit("\n## Formule estratte\n"), F.array_join(formulas, "\n")))
    parts = F.array(context, instructions, F.when(has, F.concat(F.lit("## CONTENUTO LEZIONE (slide + spiegazione orale allineate)\n\n\n"), aligned)).otherwise(plain), listed)
    return F.array_join(F.filter(F.array_compact(parts), lambda p: strip(p) != ""), "\n\n")


def assemble(sources: DataFrame, lesson: str, role: str, seq: str, name: str, text: str) -> DataFrame:
    """lesson, prompt: the sources of each lesson by role and position, each cut to its role's budget."""
    order = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col(role)).cast("int")
    body = F.concat(F.lit("## "), F.col(role), F.lit(": "), F.col(name), F.lit("\n"), truncate(F.col(text), role_budget(F.col(role))))
    return sources.where(strip(F.col(text)) != "").groupBy(lesson).agg(ordered_join(F.struct(order.alias("r"), F.col(seq).alias("s")), body, "\n\n").alias("prompt"))


def top_images(images: DataFrame, lesson: str, order: list[str], most: int = IMAGES) -> DataFrame:
    """The first `most` images of a lesson, with their rank."""
    return images.withColumn("rank", F.row_number().over(Window.partitionBy(lesson).orderBy(*order))).where(F.col("rank") <= most)


def run_file(lessons: DataFrame, run: str, number: str) -> DataFrame:
    """run, tex: a part with the inputs of its lessons in order."""
    one = F.format_string("\\input{lezione_%02d}", F.col(number))
    return lessons.groupBy(run).agg(F.concat(F.lit("\\part{Parte "), F.first(run).cast("string"), F.lit("}\n"), ordered_join(F.col(number), one)).alias("tex"))


def main_file(parts: DataFrame, course: str, stem: str) -> DataFrame:
    """course, tex: the includes of a course, ordered by name."""
    return parts.groupBy(course).agg(ordered_join(F.col(stem), F.concat(F.lit("\\include{"), F.col(stem), F.lit("}"))).alias("tex"))


def lesson_file(number: Column, title: Column, made: Column, content: Column) -> Column:
    return F.concat(F.lit("% Lezione "), number.cast("string"), F.lit(": "), title, F.lit("\n% "), F.date_format(made, "yyyy-MM-dd HH:mm"), F.lit("\n\n"), content, F.lit("\n"))


def slide_objects_text(number: Column, title: Column, objects: Column, notes: Column) -> Column:
    """A slide as plain text. objects: structs of obj_type, content and latex_result."""
    formula = lambda o: F.concat(F.lit("[FORMULA: "), F.coalesce(o.latex_result, o.content), F.lit("]"))
    one = lambda o: F.when(o.obj_type == "omml_formula", formula(o)).when((o.obj_type == "image") & o.latex_result.isNotNull(), formula(o)).when(o.obj_type == "table", F.concat(F.lit("[TABELLA: "), o.content, F.lit("]"))).when(o.obj_type == "text", o.content)
    head = F.concat(F.lit("--- SLIDE "), number.cast("string"), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(F.lit("")), F.lit(" ---"))
    note = F.when(notes != "", F.concat(F.lit("[NOTE PRESENTER: "), notes, F.lit("]")))
    return F.array_join(F.concat(F.array(head), F.array_compact(F.transform(objects, one)), F.array_compact(F.array(note))), "\n")


def slide_fallback(title: Column, objects: Column) -> Column:
    """A slide's texts other than its title."""
    return F.array_join(F.transform(F.filter(objects, lambda o: (o.obj_type == "text") & (strip(o.content) != strip(title))), lambda o: o.content), "\n")


def skeleton(title: Column, objects: Column, image: Column) -> Column:
    """LaTeX of a slide without a model: heading, figure, texts as blocks, formulas as equations, tables as they are."""
    one = lambda o: F.when(o.obj_type == "text", latex.text_block(o.content)).when(o.latex_result.isNotNull(), F.concat(F.lit("\\begin{equation}\n"), latex.sanitize_formula(o.latex_result), F.lit("\n\\end{equation}"))).when(o.obj_type == "table", o.content)
    shown = F.filter(objects, lambda o: ~((o.obj_type == "text") & (strip(o.content) == strip(title))))
    parts = F.concat(F.array(F.concat(F.lit("\\subsection{"), latex.escape(title), F.lit("}"))), F.array_compact(F.array(F.when(image.isNotNull(), latex.figure(image, title)))), F.array_compact(F.transform(shown, one)))
    return F.array_join(parts, "\n")


#: Lines of a transcript that a chapter without a model quotes.
QUOTED = 60


def deck_fallback(number: Column, title: Column, skeletons: Column, transcript: Column) -> Column:
    """A chapter without a model: the slides' skeletons in order, then the first lines of the transcript."""
    rows = F.split(transcript, "\n")
    cut = F.when(F.size(rows) > QUOTED, F.array(F.lit("\\emph{[trascrizione troncata]}"))).otherwise(F.expr("cast(array() as array<string>)"))
    quote = F.concat(F.array(F.lit("\n\\subsection{Trascrizione Audio}"), F.lit("\\begin{quote}")), F.transform(F.slice(rows, 1, QUOTED), latex.escape), cut, F.array(F.lit("\\end{quote}\n")))
    head = F.array(F.concat(F.lit("\\section{Lezione "), number.cast("string"), F.lit(": "), latex.escape(title), F.lit("}")))
    spoken = F.when(F.coalesce(transcript, F.lit("")) != "", quote).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_join(F.concat(head, skeletons, spoken), "\n")


def table_rows(rows: Column) -> Column:
    """A page's table as text, a line for each row with a filled cell; null cells are empty."""
    cell = lambda c: strip(F.coalesce(c, F.lit("")))
    filled = F.filter(rows, lambda r: F.exists(r, lambda c: cell(c) != ""))
    return F.array_join(F.transform(filled, lambda r: F.array_join(F.transform(r, cell), " | ")), "\n")


def prompt_report(system: Column, user: Column, images: Column) -> Column:
    """What a model is asked, with the list of the images that go with it."""
    listed = F.transform(images, lambda name, i: F.concat(F.lit("  ["), F.lpad((i + 1).cast("string"), F.greatest(F.lit(2), F.length((i + 1).cast("string"))), F.lit("0")), F.lit("] "), name))
    shown = F.when(F.size(images) > 0, F.concat(F.lit("\n\n=== IMMAGINI ALLEGATE ("), F.size(images).cast("string"), F.lit(") ===\n"), F.array_join(listed, "\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("=== SYSTEM ===\n"), system, F.lit("\n\n=== USER ===\n"), user, shown)


def page_skeleton(page: Column, image: Column, sections: Column, stem: Column) -> Column:
    """LaTeX of a page: its first title as heading, else its number; a figure; later titles below."""
    label = F.concat(F.lit("\\label{subsec:"), stem, F.lit("-pag"), F.lpad(page.cast("string"), F.greatest(F.lit(3), F.length(page.cast("string"))), F.lit("0")), F.lit("}\n"))
    first = F.try_element_at(sections, F.lit(1))
    titled = F.coalesce(first.heading, F.lit("")) != ""
    head = F.when(titled, F.concat(F.lit("\n\\subsection{"), latex.escape(first.heading), F.lit("}"), label)).otherwise(F.concat(F.lit("\n\\subsection*{Pagina "), page.cast("string"), F.lit("}"), label))
    fig = F.when(image.isNotNull(), latex.figure(image, F.concat(F.lit("Pagina "), page.cast("string"), F.lit(" — "), stem)))
    below = lambda s, i: F.concat(F.when((i > 0) & (s.heading != ""), F.concat(F.lit("\\subsubsection{"), latex.escape(s.heading), F.lit("}\n\n"))).otherwise(F.lit("")), F.when(s.body != "", F.concat(latex.escape(s.body), F.lit("\n"))).otherwise(F.lit("")))
    return F.array_join(F.concat(F.array_compact(F.array(head, fig)), F.filter(F.transform(sections, below), lambda x: x != "")), "\n")


def lesson_skeleton(sources: DataFrame, lesson: str, role: str, seq: str, text: str) -> DataFrame:
    """lesson, tex: all skeleton sources with LaTeX, else the support ones."""
    has = F.max((F.col(role) == "SCHELETRO") & (F.col(text) != "")).over(Window.partitionBy(lesson))
    kept = sources.withColumn("_has", F.coalesce(has, F.lit(False))).where((F.col(text) != "") & (((F.col(role) == "SCHELETRO") & F.col("_has")) | ((F.col(role) == "SUPPORTO") & ~F.col("_has"))))
    return kept.groupBy(lesson).agg(ordered_join(F.col(seq), F.col(text), "\n\n").alias("tex"))

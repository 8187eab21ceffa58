"""Queries of sources, sinks, job tables, outside tools and lesson memory that the other modules do not have."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import latex
from scriptorium.functions.text import plausible_latex
from scriptorium.operators import classify, context, jobs, render
from scriptorium.plans.texts import query
from scriptorium.session import new_dir, ship, table
from scriptorium.sources import connectors, files, sinks
from scriptorium.streaming import streams

#: Tasks for each core where rows are small and their work is not.
TASKS = 4
STATUS = "case event_type when 'signup' then 'queued' when 'view' then 'running' when 'error' then 'error' else 'done' end"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _pick(number: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (number % len(values) + 1).cast("int"))


@query("text_files", "select 'n_nationkey=' || n_nationkey as lesson, 'text' as kind, 'txt' as ext, n_name || chr(10) as text from nation")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as a file for each key, and the folder scanned and read again."""
    path = new_dir(spark, "texts")
    sinks.write_texts(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("text")), path, "n_nationkey", "text")
    found = files.scan_folder(spark, path)
    return files.texts(found).select("lesson", "kind", "ext", "text")


@query("state_files", "select p_partkey, p_name from part where p_size % 2 = 0 union all select p_partkey, 'error: odd' from part where p_size % 2 = 1")
def state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and errors in tables of their own, the results' state replaced as a whole, and both read again."""
    path = new_dir(spark, "results")
    rows = _parts(spark, sf_dir).select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 1, "odd").alias("error"))
    sinks.split_results(rows, path)
    sinks.write_state(spark.read.parquet(f"{path}/results"), f"{path}/state")
    bad = spark.read.parquet(f"{path}/errors").select("p_partkey", F.concat(F.lit("error: "), "error").alias("p_name"))
    return spark.read.parquet(f"{path}/state").unionByName(bad)


@query("notes_filter", "select p_partkey, p_partkey % 7 not in (3, 5) as placeholder from part")
def notes_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = ("Click to edit notes", "***", "ab", "una nota vera", "  — ", "xyz", "FARE CLIC PER MODIFICARE il testo")
    return _parts(spark, sf_dir).select("p_partkey", classify.notes_placeholder(_pick(F.col("p_partkey"), notes)).alias("placeholder"))


@query("lesson_files", "select o_orderkey, '% Lezione ' || o_orderkey % 30 || ': ' || o_orderpriority || chr(10) || '% ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || chr(10) || chr(10) || 'corpo' || chr(10) as tex from orders")
def lesson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", render.lesson_file(F.col("o_orderkey") % 30, F.col("o_orderpriority"), F.col("o_orderdate"), F.lit("corpo")).alias("tex"))


@query("progress_events", "select event_id, greatest(0, least(100, event_id % 300 - 100)) as progress, event_type as current_step, greatest(0, least(100, event_id % 130)) as clamped from events")
def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    made = sinks.progress_event(k, k % 300 - 100, F.col("event_type"), F.lit(""), F.col("ts"))
    return _events(spark, sf_dir).select("event_id", made.progress.alias("progress"), made.current_step.alias("current_step"), jobs.clamp_progress(k % 130).alias("clamped"))


@query("coercions", """
select event_id, event_id % 6 in (0, 1) as flag, case event_id % 6 when 3 then 12 end as positive, case event_id % 6 when 0 then 'true' when 5 then 'abc' end as known, event_id % 4 = 0 as safe from events""")
def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pick(F.col("event_id"), ("true", "YES", "0", "12", "-3", "abc"))
    name = _pick(F.col("event_id"), ("a.tex", "../a.tex", "b/a.tex", "a.pdf"))
    return _events(spark, sf_dir).select("event_id", jobs.to_boolean(raw).alias("flag"), jobs.positive_or_null(raw).alias("positive"), jobs.known_or_null(raw, ("true", "abc")).alias("known"), files.safe_path(name).alias("safe"))


@query("classifier_sample", "select doc_id, left(text, 3000) || ' ' || left(reverse(text), 2000) as sample from documents")
def classifier_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify.sample(F.col("text"), F.reverse("text")).alias("sample"))


@query("retries", "select event_id, case when event_id % 3 = 2 then null when event_id % 4 >= 3 then null else 20 * (event_id % 4) end as wait from events")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", jobs.retry_wait(F.col("event_id") % 4, _pick(F.col("event_id"), (429, 529, 500))).alias("wait"))


@query("jobs_listed", f"select event_id, {STATUS} as status from events where {STATUS} = 'done' and user_id not in (select c_custkey from customer where c_custkey % 5 = 0)")
def jobs_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs of those that were not deleted."""
    j = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("c_custkey"), F.expr(STATUS).alias("status"), F.col("ts").alias("created_at"))
    gone = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select("c_custkey")
    return jobs.listing(jobs.delete(j, gone, "c_custkey"), done_only=True).select("event_id", "status")


@query("log_tail", "select event_id, event_type as text from events where event_id % 5 <> 0")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "  ").otherwise(F.col("event_type"))
    return streams.tail(_events(spark, sf_dir).select("event_id", text.alias("text")), "event_id", "text")


@query("default_fill", "select p_partkey, case when p_partkey % 3 = 0 then p_brand else p_name end as title, case when p_partkey % 2 = 0 then p_type else 'fisica' end as subject from part")
def default_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title, subject = context.fill_defaults(F.when(k % 3 == 0, "").otherwise(F.col("p_name")), F.col("p_brand"), F.when(k % 2 == 0, "generico").otherwise("fisica"), F.col("p_type"))
    return _parts(spark, sf_dir).select("p_partkey", title.alias("title"), subject.alias("subject"))


@query("context_render", """
with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as number, o_orderpriority as p from orders),
f as (select o_custkey, p, min(number) as first from o group by all),
b as (select a.o_custkey, a.number, count(b.number) as n, max(b.number) as last, string_agg('  Lez. ' || b.number || ': ' || b.o_orderkey || ' → ' || b.p, chr(10) order by b.number) as rows
  from o a left join o b on a.o_custkey = b.o_custkey and b.number < a.number and b.number >= a.number - 5 group by all),
k as (select o.o_custkey, o.number, string_agg(f.p, ', ' order by f.first) filter (f.first < o.number) as known from o join f on o.o_custkey = f.o_custkey group by all)
select b.o_custkey, b.number, '## CONTESTO DEL CORSO' || chr(10) || 'Corso: C' || b.o_custkey || case when b.o_custkey % 2 = 0 then chr(10) || 'Prerequisiti già trattati: algebra, analisi' else '' end || chr(10) || 'Notazione del corso: $x$ = lo stato' ||
  case when n > 0 then chr(10) || chr(10) || 'Lezioni precedenti:' || chr(10) || rows || chr(10) || chr(10) || '## RACCORDO CON LEZIONE PRECEDENTE' || chr(10) || 'Nella Lezione ' || last || ' il professore si è fermato verbalmente su:' || chr(10) || '  "fine"' ||
    chr(10) || chr(10) || 'Concetti già introdotti (NON ri-spiegare da zero): ' || known || chr(10) || 'Definizioni già fornite (non ripetere): limite' else '' end || chr(10) as block
from b join k on b.o_custkey = k.o_custkey and b.number = k.number""")
def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context block of every order's lesson: earlier lessons of the customer, their concepts, and what stays the same."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("title"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("number"), F.array("o_orderpriority").alias("concepts"))
    d = context.previous(context.known(o, "o_custkey", "number", "concepts"), "o_custkey", "number", "title", "concepts")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none = F.expr("cast(array() as array<string>)")
    notation = F.array(F.struct(F.lit("x").alias("symbol"), F.lit("lo stato").alias("meaning")))
    required = F.when(F.col("o_custkey") % 2 == 0, words("algebra", "analisi")).otherwise(none)
    block = context.render(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), required, notation, F.col("before"), F.lit("fine"), F.col("known"), words("limite"))
    return d.select("o_custkey", "number", block.alias("block"))


@query("recognised", r"""
select p_partkey, case when p_partkey % 3 = 0 then 'x^2' when p_partkey % 5 = 0 then '\frac{a}{b}' when p_size % 2 = 0 then '\frac{\cdot}{\cdot}' when p_size > 5 then '\text{[formula]}' end as latex from part""")
def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade of answers, of which the first plausible one counts, and what the pixels say where there is none."""
    k = F.col("p_partkey")
    one, two = F.when(k % 3 == 0, "x^2").otherwise(".."), F.when(k % 5 == 0, r"\frac{a}{b}").otherwise("12")
    pixel = classify.pixel_formula(F.col("p_size") % 2 == 0, F.when(F.col("p_size") > 5, 0.2).otherwise(0.01))
    return _parts(spark, sf_dir).select("p_partkey", F.coalesce(classify.first_valid((one, plausible_latex(one)), (two, plausible_latex(two))), pixel).alias("latex"))


@query("tool_cache", """
with c as (select distinct md5(html) as md5 from pages)
select md5, case when md5 < '8' then 'kept' end as result, md5 >= '8' as failed, true as attempted from c""")
def tool_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool over distinct contents, half of which have an answer already; none of the others is the file that the tool reads."""
    ship(spark)
    pages = table(spark, sf_dir, "pages").select(F.encode("html", "UTF-8").alias("content"))
    kept = files.content_table(pages).where("md5 < '8'").select("md5", F.lit("kept").alias("result"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("attempted"))
    return connectors.run(pages, "docx", kept).select("md5", "result", F.col("error").isNotNull().alias("failed"), "attempted")


def presentation(slides: list[dict]) -> bytes:
    """A small PPTX file, the same bytes in every run. slides: title, notes and shapes, each (kind, top, content).

    Parts are numbered from the last slide, so only the presentation's list tells their order; a formula stands in a group
    that is drawn at half its inner size, as the alternative that programs with formulas choose.
    """
    office, kind = "http://schemas.openxmlformats.org/", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    ns = f'xmlns:a="{office}drawingml/2006/main" xmlns:p="{office}presentationml/2006/main" xmlns:m="{office}officeDocument/2006/math" xmlns:mc="{office}markup-compatibility/2006" xmlns:r="{kind}"'
    word = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    at = lambda y: f'<a:xfrm><a:off x="0" y="{y}"/><a:ext cx="9" cy="9"/></a:xfrm>'
    links = lambda rows: f'<Relationships xmlns="{office}package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{kind}/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)
        put("_rels/.rels", links([("rId1", "officeDocument", "ppt/presentation.xml")]))
        put("ppt/presentation.xml", f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + k}" r:id="s{k}"/>' for k in range(len(slides))) + "</p:sldIdLst></p:presentation>")
        put("ppt/_rels/presentation.xml.rels", links([(f"s{k}", "slide", f"slides/slide{len(slides) - k}.xml") for k in range(len(slides))]))
        for k, s in zip(range(len(slides), 0, -1), slides, strict=True):
            body = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr>{at(0)}</p:spPr><p:txBody>{word(s["title"])}</p:txBody></p:sp>' if s["title"] else ""
            for shape, y, content in s["shapes"]:
                if shape == "text":
                    body += f"<p:sp><p:spPr>{at(y)}</p:spPr><p:txBody>{word(content)}</p:txBody></p:sp>"
                elif shape == "omml_formula":
                    inner = f"<p:sp><p:spPr>{at(2 * y + 14)}</p:spPr><p:txBody><a:p><m:oMath><m:r><m:t>{content}</m:t></m:r></m:oMath></a:p></p:txBody></p:sp>"
                    frame = f'<a:xfrm><a:off x="0" y="{y}"/><a:ext cx="50" cy="50"/><a:chOff x="0" y="{2 * y + 14}"/><a:chExt cx="100" cy="100"/></a:xfrm>'
                    body += f'<p:grpSp><p:grpSpPr>{frame}</p:grpSpPr><mc:AlternateContent><mc:Choice Requires="a14">{inner}</mc:Choice><mc:Fallback><p:sp><p:txBody>{word("?")}</p:txBody></p:sp></mc:Fallback></mc:AlternateContent></p:grpSp>'
                elif shape == "table":
                    rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{word(c)}</a:txBody></a:tc>" for c in row) + "</a:tr>" for row in content)
                    body += f"<p:graphicFrame><p:xfrm><a:off x='0' y='{y}'/><a:ext cx='9' cy='9'/></p:xfrm><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
                else:
                    body += f'<p:pic><p:blipFill><a:blip r:embed="rId{k}"/></p:blipFill><p:spPr>{at(y)}</p:spPr></p:pic>'
                    put(f"ppt/media/image{k}.png", content)
            put(f"ppt/slides/slide{k}.xml", f"<p:sld {ns}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>")
            put(f"ppt/slides/_rels/slide{k}.xml.rels", links([(f"rId{k}", "image", f"../media/image{k}.png"), ("n", "notesSlide", f"../notesSlides/notesSlide{k}.xml")]))
            put(f"ppt/notesSlides/notesSlide{k}.xml", f'<p:notes {ns}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody>{word(s["notes"])}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>')
    return out.getvalue()


@query("pptx_slides", r"""
select p_partkey, n, title, case when n = 1 then 'nota di ' || p_name else '' end as notes,
  case when n = 1 then ['table:\begin{tabular}{|l|l|}' || chr(10) || '\hline' || chr(10) || p_type || ' & ' || p_size || ' \\' || chr(10) || '\hline' || chr(10) || 'x &  \\' || chr(10) || '\hline' || chr(10) || '\end{tabular}', 'omml_formula:\alpha' || p_size, 'text:' || p_name, 'image:' || md5('img' || p_size)] else ['text:fine'] end as objects
from (select *, unnest([1, 2]) as n, 'Titolo ' || p_size as title from part)""")
def pptx_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentations made of parts, and their slides: title, objects from top to bottom, notes that are no prompt."""
    ship(spark)

    def made(batches):
        for batch in batches:
            rows = batch.to_pylist()
            files_ = [presentation([
                {"title": f"Titolo {r['p_size']}", "notes": f"nota di {r['p_name']}", "shapes": [("text", 300, r["p_name"]), ("image", 400, f"img{r['p_size']}".encode()), ("omml_formula", 200, f"α{r['p_size']}"), ("table", 100, [[r["p_type"], str(r["p_size"])], ["x"]])]},
                {"title": f"Titolo {r['p_size']}", "notes": "Click to edit", "shapes": [("text", 5, "fine")]},
            ]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files_, pa.binary())], names=["p_partkey", "content"])

    # a part is a few bytes and a presentation milliseconds of work, so the table is dealt out by work, not by its bytes
    parts = _parts(spark, sf_dir).select("p_partkey", "p_name", "p_type", "p_size").repartition(TASKS * spark.sparkContext.defaultParallelism)
    d = parts.mapInArrow(made, "p_partkey bigint, content binary")
    s = connectors.slides(d, "content")
    return s.select("p_partkey", F.col("slide_number").alias("n"), "title", "notes", F.transform("objects", lambda o: F.concat_ws(":", o.obj_type, F.coalesce(o.latex_result, o.content))).alias("objects"))


@query("pdf_tables", """
with t as (select l_orderkey, l_linenumber, l_partkey, l_returnflag as a, case when l_linenumber % 3 = 0 then null else l_linestatus end as b, case when l_linenumber % 4 = 0 then '' end as c, l_linenumber % 5 = 0 as blank from lineitem)
select l_orderkey, string_agg(coalesce(a, '') || ' | ' || coalesce(b, '') || ' | ' || coalesce(c, ''), chr(10) order by l_linenumber, l_partkey, a, b) as text from t where not blank group by l_orderkey""")
def pdf_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables as text, those without any filled cell left out."""
    blank = F.col("l_linenumber") % 5 == 0
    cells = F.array(F.col("l_returnflag"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")), F.when(F.col("l_linenumber") % 4 == 0, ""))
    empty = F.array(F.lit(""), F.lit(None).cast("string"), F.lit("  "))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("at"), F.when(blank, empty).otherwise(cells).alias("cells"))  # noqa: E741
    g = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cells"))), lambda r: r.cells).alias("rows"))
    return g.select("l_orderkey", render.table_rows(F.col("rows")).alias("text")).where("text <> ''")


def _chain_sql(column: str, characters: str) -> str:
    made = {"\\": "\\textbackslash{}", "^": "\\^{}", "~": "\\~{}"}
    for c in characters:
        column = f"replace({column}, '{c}', '{made.get(c, chr(92) + c)}')"
    return column


@query("fallback_escapes", rf"""
select doc_id, {_chain_sql('t', chr(92) + '&%$#_^{}~')} as title, {_chain_sql('t', chr(92) + '&%$#{}')} as chapter, {_chain_sql('t', '&%$#_{}')} as cell,
  array_to_string(list_transform(string_split(t, ''), lambda c: case when c = chr(92) then chr(92) || 'textbackslash{{}}' when c = '~' then chr(92) || 'textasciitilde{{}}' when c = '^' then chr(92) || '^{{}}' when contains('&%$#_{{}}', c) then chr(92) || c else c end), '') as once
from (select doc_id, text || ' a\b & {{50%}} #1 x_n ~ y^2 <z>' as t from documents)""")
def fallback_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(r" a\b & {50%} #1 x_n ~ y^2 <z>"))
    made = {"title": latex.escape_chained(t), "chapter": latex.escape_chained(t, latex.TEXT_CHAIN), "cell": latex.escape_chained(t, latex.CELL_CHAIN), "once": latex.escape_once(t)}
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in made.items()])


@query("deck_fallback", r"""
with d as (select doc_id, string_split(regexp_replace(text, '[^\p{L}\p{N}\s.,;:!?&%$]', '', 'g'), chr(10)) as ls from documents where text <> ''),
e as (select doc_id, len(ls) as n, list_transform(ls[1:60], lambda l: replace(replace(replace(l, '&', '\&'), '%', '\%'), '$', '\$')) as ls from d)
select doc_id, '\section{Lezione 3: T}' || chr(10) || chr(10) || '\subsection{Trascrizione Audio}' || chr(10) || '\begin{quote}' || chr(10) || array_to_string(ls, chr(10)) ||
  case when n > 60 then chr(10) || '\emph{[trascrizione troncata]}' else '' end || chr(10) || '\end{quote}' || chr(10) as tex from e""")
def deck_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter without slides and without a model: the transcript's first lines."""
    plain = F.regexp_replace("text", r"[^\p{L}\p{N}\s.,;:!?&%$]", "")
    none = F.expr("cast(array() as array<string>)")
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", render.deck_fallback(F.lit(3), F.lit("T"), none, plain).alias("tex"))


@query("prompt_report", """
with i as (select l_orderkey, string_agg('  [' || lpad(r::varchar, 2, '0') || '] p' || l_partkey || '.png', chr(10) order by r) as t, count(*) as n
  from (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as r from lineitem) group by l_orderkey)
select o_orderkey, '=== SYSTEM ===' || chr(10) || 'sys' || chr(10) || chr(10) || '=== USER ===' || chr(10) || o_orderpriority || coalesce(chr(10) || chr(10) || '=== IMMAGINI ALLEGATE (' || n || ') ===' || chr(10) || t, '') as report from orders left join i on o_orderkey = l_orderkey""")
def prompt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every order's lesson with the list of its images."""
    images = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("p"), x.l_partkey.cast("string"), F.lit(".png"))).alias("images"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(images, "o_orderkey", "left")
    none = F.expr("cast(array() as array<string>)")
    return d.select("o_orderkey", render.prompt_report(F.lit("sys"), F.col("o_orderpriority"), F.coalesce("images", none)).alias("report"))


@query("ocr_pages", "select page_id, case when page_id % 3 = 2 then 'eng+ita' when page_id % 3 = 1 then 'ita' else 'eng' end as lang, strlen(html) < 3000 as sparse from pages")
def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are read by recognition, and in which language."""
    lang = _pick(F.col("page_id"), (" EN", "it", "fr"))
    text = F.when(F.octet_length("html") < 3000, "  short ").otherwise(F.repeat(F.lit("x"), 80))
    return table(spark, sf_dir, "pages").select("page_id", classify.ocr_language(lang).alias("lang"), classify.is_sparse(text).alias("sparse"))


@query("image_fit", "select p_partkey, cast(floor(w * least(1.0, 1920.0 / greatest(w, h))) as integer) as width, cast(floor(h * least(1.0, 1920.0 / greatest(w, h))) as integer) as height from (select p_partkey, p_size * 64 as w, (p_partkey % 50 + 1) * 80 as h from part)")
def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 64, (F.col("p_partkey") % 50 + 1) * 80
    return _parts(spark, sf_dir).select("p_partkey", connectors.fitted(w, h).alias("s")).select("p_partkey", "s.*")


@query("zip_outputs", """
select o_custkey, count(*) as n_files, string_agg('lezione_' || o_orderkey || '.tex=' || o_orderpriority, ';' order by 'lezione_' || o_orderkey || '.tex') as files from orders group by o_custkey""")
def zip_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each customer as an archive, and the archives read again."""
    ship(spark)

    def read(batches):
        for batch in batches:
            names = []
            for content in batch.column(1).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names.append([f"{n}={z.read(n).decode()}" for n in z.namelist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(n) for n in names], pa.int64()), pa.array([";".join(n) for n in names])], names=["o_custkey", "n_files", "files"])

    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("lezione_"), F.col("o_orderkey").cast("string"), F.lit(".tex")).alias("name"), F.col("o_orderpriority").alias("text"))
    return sinks.zipped(o, "o_custkey", "name", "text").mapInArrow(read, "o_custkey bigint, n_files bigint, files string")


@query("fetch_once", "select distinct url, case when contains(url, '/es/') then null else cast(length(url) as bigint) end as n_bytes, contains(url, '/es/') as failed from pages")
def fetch_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses read by a stand-in for the network, some of which fail."""
    ship(spark)

    def get(url: str) -> bytes:
        if "/es/" in url:
            raise RuntimeError("not found")
        return url.encode()

    d = connectors.fetched(table(spark, sf_dir, "pages"), "url", get)
    return d.select("url", F.octet_length("content").cast("long").alias("n_bytes"), F.col("error").isNotNull().alias("failed"))


def letter(parts: list[tuple[str, object]]) -> bytes:
    """A minimal DOCX file, the same bytes in every run. parts: (style or `table`, text or rows of cells)."""
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    words = lambda t: f"<w:r><w:t>{escape(t)}</w:t></w:r>"
    body = ""
    for kind, content in parts:
        if kind == "table":
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{words(c)}</w:p></w:tc>" for c in row) + "</w:tr>" for row in content) + "</w:tbl>"
        else:
            style = f'<w:pPr><w:pStyle w:val="{kind}"/></w:pPr>' if kind else ""
            body += f"<w:p>{style}{words(content)}</w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("docx_texts", """
select p_partkey, '## ' || p_name || chr(10) || p_type || chr(10) || '[TABELLA]' || chr(10) || p_brand || ' | ' || p_size || chr(10) || 'x | y' || chr(10) || '# Titolo' as text from part""")
def docx_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of parts, read as text: headings by level, rows that repeat the row before left out."""
    ship(spark)

    def made(batches):
        for batch in batches:
            rows = batch.to_pylist()
            docs = [letter([("Heading2", r["p_name"]), ("", r["p_type"]), ("", "  "), ("table", [[r["p_brand"], str(r["p_size"])], [r["p_brand"], str(r["p_size"])], ["x", "y"]]), ("Titolo1", "Titolo")]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(docs, pa.binary())], names=["p_partkey", "content"])

    d = _parts(spark, sf_dir).select("p_partkey", "p_name", "p_brand", "p_type", "p_size").mapInArrow(made, "p_partkey bigint, content binary")
    read = connectors.run(d, "docx").where("error is null").select("md5", F.col("result").alias("text"))
    return d.select("p_partkey", F.md5("content").alias("md5")).join(read, "md5").select("p_partkey", "text")

"""Queries of ordered segments, sections, pages and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import formulas
from scriptorium.operators import classify, render, sequence
from scriptorium.plans.texts import ORACLE_SQL, query
from scriptorium.session import ship, table


@query("align_segments", """
with s as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) as t, row_number() over (partition by user_id order by ts, event_id) as seq from events),
g as (select *, least(coalesce(t - lag(t) over (partition by user_id order by seq), 0), 45) as gap from s),
c as (select *, sum(gap) over (partition by user_id order by seq) as speech from g),
m as (select *, greatest(1.0, cast(last_value(speech) over (partition by user_id order by seq rows between unbounded preceding and unbounded following) as double)) as total from c)
select event_id, user_id, cast(speech as bigint) as speech, cast(greatest(0, least(9, floor(speech / total * 10))) as integer) as idx from m""")
def align_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return sequence.align_timed(e, "user_id", ["ts", "event_id"], "t", F.lit(10)).select("event_id", "user_id", "speech", "idx")


@query("align_uniform", """
with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as p, count(*) over (partition by conv_id) as n from conversations)
select conv_id, turn, cast(least(2, p // greatest(1, n // 3)) as integer) as idx from r""")
def align_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.align_uniform(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], F.lit(3))


@query("aligned_blocks", """
with r as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 as p, count(*) over (partition by conv_id) as n from conversations),
s as (select conv_id, turn, text, cast(least(2, p // greatest(1, n // 3)) as integer) as idx from r),
k as (select distinct conv_id, i as slide_pos from conversations, range(3) t(i) where conv_id % 5 <> 0),
b as (select k.conv_id, slide_pos, string_agg(text, chr(10) order by turn) as oral from k left join s on s.conv_id = k.conv_id and s.idx = k.slide_pos group by all)
select conv_id, cast(slide_pos as integer) as slide_pos, '### Slide ' || (slide_pos + 1) || ': Parte' || case when slide_pos = 1 then chr(10) || '[CONTENUTO SLIDE]' || chr(10) || 'corpo' else '' end ||
  case when oral is not null then chr(10) || '[SPIEGAZIONE ORALE]' || chr(10) || oral else '' end || chr(10) as block from b
union all
select conv_id, 0, '### Slide 0: Trascrizione' || chr(10) || '[SPIEGAZIONE ORALE]' || chr(10) || string_agg(text, chr(10) order by turn) || chr(10) from s where conv_id % 5 = 0 group by conv_id""")
def aligned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    segments = sequence.align_uniform(c, "conv_id", ["turn"], F.lit(3)).select("conv_id", F.col("turn").alias("seq"), F.lit(-1).alias("time_sec"), "text", "idx")
    slides = c.where("conv_id % 5 <> 0").select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("slide_pos"))
    slides = slides.select("conv_id", "slide_pos", (F.col("slide_pos") + 1).alias("slide_num"), F.lit("Parte").alias("title"), F.when(F.col("slide_pos") == 1, "corpo").otherwise("").alias("body"))
    b = sequence.aligned_blocks(slides, segments, "conv_id")
    return b.select("conv_id", "slide_pos", sequence.render_block(F.col("slide_num"), F.col("title"), F.col("body"), F.col("said")).alias("block"))


@query("transcript_detect", r"""
with t as (select conv_id, string_agg(case when role = 'user' then '[00:' || lpad((turn % 60)::varchar, 2, '0') || '] ' else '' end || text, chr(10) order by turn) as t from conversations group by conv_id),
l as (select conv_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from t)
select conv_id, len(ls) > 0 and len(list_filter(ls, lambda x: regexp_matches(x, '^\[\d\d:\d\d\]'))) / len(ls) >= case when len(ls) <= 10 then 0.30 else 0.10 end as is_transcript from l""")
def transcript_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of whole conversations, those of users stamped."""
    line = F.concat(F.when(F.col("role") == "user", F.concat(F.lit("[00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("] "))).otherwise(""), F.col("text"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(render.ordered_join(F.col("turn"), line).alias("t"))
    return g.select("conv_id", classify.is_transcript(F.col("t")).alias("is_transcript"))


@query("transcript_parse", """
with t as (select doc_id, pos, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) where trim(line) <> '')
select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as integer) as seq, cast(pos % 60 * 60 + 7 as integer) as time_sec, trim(line) as text from t""")
def transcript_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("["), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(":07] "), x))
    kept = F.filter(stamped, lambda x: F.length(F.trim(x)) > 7)
    return sequence.parse_transcript(table(spark, sf_dir, "documents").select("doc_id", F.array_join(kept, "\n").alias("text")), "doc_id", F.col("text"))


#: A lesson is a source's documents among a hundred ids, so that lessons stay small in tables of any size.
ROLES = """
with l as (select doc_id, source, source || '-' || (doc_id // 100) as lesson, text from documents),
s as (select doc_id, source, lesson, row_number() over (partition by lesson order by doc_id) as seq, case doc_id % 6 when 0 then 'slide' when 1 then 'text' when 2 then 'pdf' when 3 then 'doc' when 4 then 'text' else 'pdf' end as kind0, text from l),
k as (select *, case when kind0 = 'slide' and source in ('src1', 'src2') then 'pdf' when source = 'src4' and kind0 = 'slide' then 'audio' else kind0 end as kind from s),
w as (select *, bool_or(kind in ('slide', 'pdf', 'doc')) over (partition by lesson) as struct, bool_or(kind = 'audio') over (partition by lesson) as audio,
  min(case when kind = 'text' then seq end) over (partition by lesson) as first, kind = 'text' and source in ('src3', 'src7') and doc_id % 4 = 0 as hard from k),
f as (select *, kind = 'text' and (hard or (struct and not audio and seq = first)) as flesh from w), h as (select *, audio or bool_or(flesh) over (partition by lesson) as has_audio from f)"""


@query("role_assign", ROLES + """
select doc_id, case when kind = 'slide' then 'SCHELETRO' when kind = 'audio' or flesh then 'CARNE' when kind = 'text' then 'CONTORNO' when has_audio then 'SCHELETRO' else 'SUPPORTO' end as role, has_audio from h""")
def role_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).select("doc_id", "role", "has_audio")


def _lesson(ids: int):
    return F.concat_ws("-", "source", F.floor(F.col("doc_id") / ids).cast("string"))


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", _lesson(100).alias("lesson"), "text").withColumn("seq", F.row_number().over(Window.partitionBy("lesson").orderBy("doc_id")))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("slide", "text", "pdf", "doc", "text", "pdf")]), (F.col("doc_id") % 6 + 1).cast("int"))
    kind = F.when((kind == "slide") & F.col("source").isin("src1", "src2"), "pdf").when((kind == "slide") & (F.col("source") == "src4"), "audio").otherwise(kind)
    name = F.when(F.col("source").isin("src3", "src7") & (F.col("doc_id") % 4 == 0), "trascrizione").otherwise("nota")
    return classify.assign_roles(d.withColumns({"kind": kind, "name": name}), "lesson", "seq", "kind", "name", "text")


@query("prompt_assembly", ROLES + """,
r as (select lesson, seq, text, case when kind = 'slide' then 'SCHELETRO' when kind = 'audio' or flesh then 'CARNE' when kind = 'text' then 'CONTORNO' when has_audio then 'SCHELETRO' else 'SUPPORTO' end as role from h),
b as (select *, case role when 'CARNE' then 200000 when 'SCHELETRO' then 160000 when 'SUPPORTO' then 80000 else 40000 end as m from r), x as (select *, left(text, m) as cut from b),
c as (select *, case when contains(cut, chr(10)) and length(cut) - strpos(reverse(cut), chr(10)) > m * 0.85 then left(cut, length(cut) - strpos(reverse(cut), chr(10))) else cut end as short from x),
t as (select lesson, seq, role, case when length(text) <= m then text else short || chr(10) || chr(10) || '[... ' || format('{:,}', length(text) - length(short)) || ' caratteri omessi per rispettare il budget token ...]' end as text from c)
select lesson, string_agg('## ' || role || ': nota' || chr(10) || text, chr(10) || chr(10) order by list_position(['SCHELETRO', 'CARNE', 'SUPPORTO', 'CONTORNO'], role), seq) as prompt from t group by lesson""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.assemble(_roles(spark, sf_dir).withColumn("name", F.lit("nota")), "lesson", "role", "seq", "name", "text")


@query("synthesis_case", ROLES + """
select lesson, case when bool_or(kind = 'slide') and bool_or(kind = 'audio' or flesh) then 'slides+audio' when bool_or(kind = 'slide') then 'slides'
  when bool_or(kind in ('pdf', 'doc') and has_audio) and bool_or(kind = 'audio' or flesh) then 'document+audio' when bool_or(kind = 'audio' or flesh) then 'audio' when bool_or(kind in ('pdf', 'doc') and has_audio) then 'document' else 'none' end ||
  case when bool_or(kind in ('pdf', 'doc') and not has_audio) then '+support' else '' end as instruction from h group by lesson""")
def synthesis_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c: F.max(c)
    g = _roles(spark, sf_dir).groupBy("lesson").agg(has(F.col("kind") == "slide").alias("s"), has(F.col("role") == "SCHELETRO").alias("k"), has(F.col("role") == "CARNE").alias("f"), has(F.col("role") == "SUPPORTO").alias("x"))
    return g.select("lesson", classify.synthesis_case(F.col("s"), F.col("k"), F.col("f"), F.col("x")).alias("instruction"))


@query("section_sessionize", """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
s as (select *, length(line) <= 60 as head, sum(case when length(line) <= 60 then 1 else 0 end) over (partition by doc_id order by pos) as sid from l)
select doc_id, cast(sid as bigint) as sid, max(case when head then line end) as heading, coalesce(regexp_replace(string_agg(case when not head then line end, chr(10) order by pos), '^\\s+|\\s+$', '', 'g'), '') as body
from s group by doc_id, sid having max(case when head then line end) is not null or coalesce(regexp_replace(string_agg(case when not head then line end, chr(10) order by pos), '^\\s+|\\s+$', '', 'g'), '') <> ''""")
def section_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sequence.sections_by(rows, "doc_id", "pos", "line", F.when(F.length("line") <= 60, F.col("line")))


@query("title_lines", r"""
with l as (select doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10))) as line, generate_subscripts(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)), 1) - 1 as pos from documents),
t as (select doc_id, pos, trim(case when pos % 9 = 4 then upper(replace(line, 'ß', 'ss')) when pos % 9 = 6 then '2.' || pos || ') ' || line else line end) as line from l),
n as (select *, lead(line) over (partition by doc_id order by pos) as nxt, regexp_replace(line, '[^\p{L}]', '', 'g') as alpha from t)
select doc_id, cast(pos as integer) as pos from n where line <> '' and case when alpha <> '' and alpha = upper(alpha) and not regexp_matches(alpha, '[\p{Ll}\p{Lo}\p{Lm}]') then length(line) <= 150 when length(line) > 100 then false
  else coalesce(nxt = '' and len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) >= 3, false) or regexp_matches(line, '^(?:[A-Z]|(?:\d+\.)*\d+)[.)]\s+[\p{L}\p{N}_]') end""")
def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.explode_lines(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text")), "doc_id", "text")
    p = F.col("pos") % 9
    line = F.trim(F.when(p == 4, F.upper("line")).when(p == 6, F.concat(F.lit("2."), F.col("pos").cast("string"), F.lit(") "), F.col("line"))).otherwise(F.col("line")))
    d = rows.withColumn("line", line).withColumn("nxt", F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos")))
    return d.where(sequence.is_title(F.col("line"), F.col("nxt"))).select("doc_id", "pos")


@query("chunk_pages", """
with d as (select source || '-' || (doc_id // 1000) as lesson, doc_id, text as t from documents),
r as (select lesson, doc_id, row_number() over (partition by lesson order by doc_id) as p, count(*) over (partition by lesson) as n, t from d)
select lesson, cast((p - 1) // 7 as integer) as chunk, min(p) as first, max(p) as last, count(*) as n, string_agg('[PAG ' || p || ']' || chr(10) || t, chr(10) || chr(10) order by p) as text, 'pag. ' || min(p) || '–' || max(p) as title
from r where n > 20 group by lesson, (p - 1) // 7""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(_lesson(1000).alias("lesson"), "doc_id", F.col("text").alias("t"))
    d = d.withColumn("p", F.row_number().over(Window.partitionBy("lesson").orderBy("doc_id")))
    return sequence.chunk_texts(sequence.chunk_pages(d, "lesson", "p").where("chunk is not null"), "lesson", "p", "t")


@query("topk_images", "select p_brand, p_partkey, rank from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size, p_partkey) as rank from part) where rank <= 20")
def topk_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.top_images(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", ["p_size", "p_partkey"]).select("p_brand", "p_partkey", "rank")


@query("formula_images", "select p_partkey, p_size * 50 >= 20 and p_size * 9 >= 10 and not (p_size * 50 > 2000 and p_size * 9 > 800) and (p_partkey % 10) / 10.0 >= 0.5 and (p_partkey % 7) / 100.0 >= 0.02 and (p_partkey % 4) / 10.0 <= 0.25 as is_formula from part")
def formula_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 50, F.col("p_size") * 9
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", classify.is_formula_image(F.lit("png"), w, h, (k % 10) / 10.0, (k % 7) / 100.0, (k % 4) / 10.0).alias("is_formula"))


@query("table_ghosts", "select user_id, event_id from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as b from events) where b is null or b <> event_type")
def table_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sequence.drop_repeated_rows(rows, "user_id", "event_id", "event_type").select("user_id", "event_id")


def _oml(body: str) -> str:
    return f'<m:oMath xmlns:m="{formulas.MATH}">{body}</m:oMath>'


@query("omml")
def omml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as formulas: a fraction of size and key under a root, each distinct formula converted once."""
    ship(spark)
    run = lambda c: F.concat(F.lit("<m:r><m:t>"), c.cast("string"), F.lit("</m:t></m:r>"))
    head, tail = _oml("|").split("|")
    xml = F.concat(F.lit(head + "<m:rad><m:deg/><m:e><m:f><m:num>"), run(F.col("p_size")), F.lit("</m:num><m:den>"), run(F.col("p_size") % 3), F.lit("</m:den></m:f></m:e></m:rad>" + tail))
    d = table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml"))
    return formulas.convert(d, "xml", "tex").select("p_partkey", "tex")


ORACLE_SQL["omml"] = "select p_partkey, '\\sqrt{\\frac{' || p_size || '}{' || p_size % 3 || '}}' as tex from part"

"""Queries of the renderers, the formatters, the parsers of marked texts, and formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import formulas, latex
from scriptorium.functions import text as T
from scriptorium.functions.pyre import lines, name_title, safe_name, strip
from scriptorium.operators import classify, render, sequence
from scriptorium.plans.normalize import normalize
from scriptorium.plans.texts import sql_text, noise_sql, query, sql_map, subject_sql
from scriptorium.session import ship, table

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _number(c: str = "i") -> Column:
    return F.col(c).cast("string")


# Sections of a document: a line each, two of three with a heading; every fourth ends in a filler line.
SECTIONS = """s as (select doc_id, list_transform(string_split(text, chr(10)), lambda l, i: struct_pack(
  heading := case when i % 3 = 1 then '' else 'Titolo ' || (i - 1) end, body := l || case when i % 4 = 2 then chr(10) || 'come vedremo dopo' else '' end)) as s from documents)"""
RAW = """'# Doc ' || doc_id || chr(10) || coalesce(chr(10) || nullif(array_to_string(flatten(list_transform({}, lambda x: list_filter([case when x.heading <> '' then chr(10) || '## ' || x.heading end, case when x.body <> '' then x.body end], lambda y: y is not null))), chr(10)), ''), '')"""


def _sections() -> Column:
    def one(line: Column, i: Column) -> Column:
        heading = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Titolo "), i.cast("string")))
        return F.struct(heading.alias("heading"), F.concat(line, F.when(i % 4 == 1, "\ncome vedremo dopo").otherwise("")).alias("body"))

    return F.transform(F.split("text", "\n"), one)


@query("renderers", f"""
with {SECTIONS},
d as (select doc_id, s, list_filter(list_transform(s, lambda x: struct_pack(heading := x.heading, body := case when contains(x.body, chr(10)) then split_part(x.body, chr(10), 1) else x.body end)), lambda x: trim(x.body) <> '') as kept from s)
select doc_id, {RAW.format('s')} as raw, {RAW.format('kept')} as dense,
  '# Doc ' || doc_id || ' [OUTLINE]' || chr(10) || chr(10) || array_to_string(list_transform(s, lambda x, i: i || '. **' || case when x.heading = '' then 'Sezione ' || i else x.heading end || '** — ' || left(replace(x.body, chr(10), ' '), 120) || '…'), chr(10)) || chr(10) || chr(10) || '[1 formule presenti]' as outline
from d""")
def renderers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", _sections().alias("s"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"))
    return d.select("doc_id", render.raw_clean(F.col("title"), F.col("s")).alias("raw"), render.dense(F.col("title"), F.col("s")).alias("dense"), render.outline(F.col("title"), F.col("s"), F.array(F.lit("$x$"))).alias("outline"))


@query("prompt_render", f"""
with {SECTIONS}
select doc_id, array_to_string(list_filter([case when doc_id % 2 = 0 then 'CONTESTO' else ' ' end, 'TIPO DI CORSO: fisica',
  case when doc_id % 3 = 0 then '## CONTENUTO LEZIONE (slide + spiegazione orale allineate)' || chr(10) || chr(10) || chr(10) || 'allineato' else {RAW.format('s')} end,
  case when doc_id % 3 <> 0 then chr(10) || '## Formule estratte' || chr(10) || '$x$' || chr(10) || '$y$' end], lambda x: x is not null and trim(x) <> ''), chr(10) || chr(10)) as prompt from s""")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    made = render.prompt(F.when(k % 2 == 0, "CONTESTO").otherwise(" "), F.lit("TIPO DI CORSO: fisica"), F.when(k % 3 == 0, "allineato").otherwise(""), F.lit("RAW_CLEAN"), F.concat(F.lit("Doc "), k.cast("string")), _sections(), F.array(F.lit("$x$"), F.lit("$y$")))
    return _documents(spark, sf_dir).select("doc_id", made.alias("prompt"))


BOX = {"open": r"\begin{itemize}", "close": r"\end{itemize}"}


def escaped(column: str) -> str:
    return f"array_to_string(list_transform(string_split({column}, ''), lambda c: coalesce({sql_map(latex.SPECIAL | latex.text_map())}[c], c)), '')"


@query("text_block", f"""
with e as (select p_partkey, {escaped('p_name')} as a, {escaped('p_brand')} as b, {escaped('p_type')} as c from part)
select p_partkey, a || chr(10) || '{BOX['open']}' || chr(10) || '  \\item ' || b || chr(10) || '  \\item ' || c || chr(10) || '{BOX['close']}' || chr(10) || chr(10) || '{BOX['open']}' || chr(10) || '  \\item ' || a ||
  case when p_partkey % 2 = 0 then chr(10) || '{BOX['close']}' || chr(10) || chr(10) || b else chr(10) || '{BOX['close']}' end as tex from e""")
def text_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col("p_name"), F.concat(F.lit("• "), "p_brand"), F.concat(F.lit("*  "), "p_type"), F.lit(""), F.concat(F.lit("– "), "p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))]
    return _parts(spark, sf_dir).select("p_partkey", latex.text_block(F.concat_ws("\n", *parts)).alias("tex"))


@query("tabular", f"""
with e as (select p_partkey, p_size, {escaped('p_name')} as a, {escaped('p_brand')} as b from part)
select p_partkey, '\\begin{{tabular}}{{|l|l|l|}}' || chr(10) || '\\hline' || chr(10) || a || ' & ' || b || ' &  \\\\' || chr(10) || '\\hline' || chr(10) || p_size || ' & & \\\\' || chr(10) || ' & ' || b || ' & ' || a || ' \\\\' || chr(10) || '\\hline' || chr(10) || '\\end{{tabular}}' as tex from e""".replace("p_size || ' & & \\\\'", "p_size || ' &  &  \\\\'"))
def tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(F.array("p_name", "p_brand"), F.array(F.col("p_size").cast("string")), F.array(F.lit(None).cast("string"), F.col("p_brand"), F.col("p_name")))
    return _parts(spark, sf_dir).select("p_partkey", latex.tabular(rows).alias("tex"))


@query("word_wrap", r"""
select doc_id, list_reduce(list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), lambda w: [w]), lambda a, b:
  case when length(a[len(a)]) + 1 + length(b[1]) <= 40 then list_concat(a[1:len(a) - 1], [a[len(a)] || ' ' || b[1]]) else list_concat(a, b) end) as wrapped
from documents""")
def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.wrap(F.col("text"), 40).alias("wrapped"))


#: What models put before and after a chapter, and what of the closing stays.
ANSWERS = (
    ("Ecco il capitolo:\n```latex\n", "\n\\end{document}\n```\nFine.", "\n\\end{document}"),
    ("```\n", "\n\\end{itemize}\nUn saluto\n```", "\n\\end{itemize}"),
    ("Certo! ", "\n}\n  \nSpero che sia utile.", "\n}"),
    ("", "\n\\end{a}\n\\subsection{b} x\n\\end{c} \n\n", "\n\\end{a}\n\\subsection{b} x\n\\end{c}"),
    ("  \n", "", ""),
)


@query("clean_answer", r"""
select doc_id, regexp_replace('\section{Doc ' || doc_id || '}' || chr(10) || translate(text, '}`', '') || case doc_id % 5 """.replace(r"\\", "\\") + " ".join(f"when {k} then {sql_text(kept)}" for k, (_, _, kept) in enumerate(ANSWERS)) + r""" end, '^\s+|\s+$', '', 'g') as tex from documents""")
def clean_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as models give them: with and without fences, words before and after, and more than one closing."""
    k = (F.col("doc_id") % len(ANSWERS) + 1).cast("int")
    side = lambda i: F.element_at(F.array(*[F.lit(a[i]) for a in ANSWERS]), k)
    said = F.concat(side(0), F.lit("\\section{Doc "), F.col("doc_id").cast("string"), F.lit("}\n"), F.translate("text", "}`", ""), side(1))
    return _documents(spark, sf_dir).select("doc_id", T.clean_answer(said).alias("tex"))


@query("context_tail", f"select doc_id, case when length(t) > 6000 then left(t, 6000) || chr(10) || '% ... [troncato per brevità] ...' else t end as text from (select doc_id, {TRIM.format('text')} as t from documents)")
def context_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.truncate_context(F.col("text")).alias("text"))


@query("names", """
select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_brand as title,
  case when p_partkey % 7 = 0 then 'output' else p_name || '_' || replace(p_brand, '#', '') end as safe from part""")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.translate("p_name", " ", "_"), F.lit("-"), F.lower("p_brand"))
    raw = F.when(F.col("p_partkey") % 7 == 0, "?!*").otherwise(F.concat(F.lit("./"), "p_name", F.lit("/<"), "p_brand", F.lit(">..")))
    return _parts(spark, sf_dir).select("p_partkey", name_title(stem).alias("title"), safe_name(raw).alias("safe"))


@query("formula_text", r"""
select p_partkey, case when p_partkey % 5 = 0 then null else '\alpha+1' || p_size % 10 || '=0-x \cdot ' || p_size || '<y' end as fixed, p_name || '_{' || p_size || '}' as bare from part""")
def formula_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 5 == 0, " x ").otherwise(F.concat(F.lit(" alpha  + I"), (F.col("p_size") % 10).cast("string"), F.lit(" = O — x cdot "), size, F.lit(" < y\n")))
    inner, kind = F.concat(F.col("p_name"), F.lit("_{"), size, F.lit("}")), F.col("p_partkey") % 3
    wrapped = F.when(kind == 0, F.concat(F.lit("$$ "), inner, F.lit(" $$"))).when(kind == 1, F.concat(F.lit("$"), inner, F.lit("$"))).otherwise(F.concat(F.lit("\\begin{equation*}  "), inner, F.lit("\n\n\\end{equation*}")))
    return _parts(spark, sf_dir).select("p_partkey", T.fix_ocr(raw).alias("fixed"), T.bare_latex(wrapped).alias("bare"))


@query("role_truncate", """
with r as (select doc_id, ['CARNE', 'SCHELETRO', 'SUPPORTO', 'CONTORNO'][doc_id % 4 + 1] as role, repeat(text || chr(10), 1 + 60000 // length(text)) as t from documents where length(text) > 0),
c as (select *, case role when 'CARNE' then 200000 when 'SCHELETRO' then 160000 when 'SUPPORTO' then 80000 else 40000 end as m from r), x as (select *, left(t, m) as cut from c),
n as (select *, length(cut) - strpos(reverse(cut), chr(10)) as nl from x), d as (select *, case when contains(cut, chr(10)) and nl > m * 0.85 then left(cut, nl) else cut end as short from n)
select doc_id, role, case when length(t) <= m then length(t) else length(short) + length(chr(10) || chr(10) || '[... ' || format('{:,}', length(t) - length(short)) || ' caratteri omessi per rispettare il budget token ...]') end as chars,
  md5(case when length(t) <= m then t else short || chr(10) || chr(10) || '[... ' || format('{:,}', length(t) - length(short)) || ' caratteri omessi per rispettare il budget token ...]' end) as digest from d""")
def role_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in ("CARNE", "SCHELETRO", "SUPPORTO", "CONTORNO")]), (F.col("doc_id") % 4 + 1).cast("int"))
    long = F.repeat(F.concat("text", F.lit("\n")), 1 + F.floor(F.lit(60000) / F.length("text")).cast("int"))
    d = _documents(spark, sf_dir).where(F.length("text") > 0).select("doc_id", role.alias("role"), long.alias("t"))
    d = d.select("doc_id", "role", T.truncate(F.col("t"), T.role_budget(F.col("role"))).alias("t"))
    return d.select("doc_id", "role", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query("slide_parse", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)
select doc_id, cast(i as integer) as slide_pos, cast(i + 1 as integer) as slide_num, case when i % 2 = 0 then 'Parte ' || i else '' end as title, regexp_replace(line, '^\s+|\s+$', '', 'g') as body from l""")
def slide_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    def block(line: Column, i: Column) -> Column:
        title = F.when(i % 2 == 0, F.concat(F.lit(": Parte "), i.cast("string"))).otherwise("")
        return F.concat(F.lit("--- SLIDE "), (i + 1).cast("string"), title, F.lit(" ---\n"), line, F.lit("\n"))

    d = _documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), block), "").alias("text"))
    return sequence.parse_slides(d, "doc_id", F.col("text"))


@query("paragraphs", r"""
select doc_id, cast(i as integer) as pos, line from (select doc_id, unnest(string_split(replace(text, '.', '.' || chr(10) || chr(10)), chr(10) || chr(10))) as line, generate_subscripts(string_split(replace(text, '.', '.' || chr(10) || chr(10)), chr(10) || chr(10)), 1) - 1 as i from documents)
where regexp_replace(line, '\s', '', 'g') <> ''""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("."), F.lit(".\n\n")).alias("text"))
    return sequence.explode_lines(d, "doc_id", "text", "\n\n").where(strip(F.col("line")) != "")


#: Lines of a document, some of them made markers, stamped lines and capitals.
MARKED = """m as (select doc_id, i, case i % 7 when 2 then '--- Slide ' || i || ' ---' when 3 then '[00:05] ' || line when 5 then ' LEZIONE - PRIMA PARTE' when 6 then '[01:02]' else line end as line
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents))"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.explode_lines(_documents(spark, sf_dir), "doc_id", "text")
    k = F.col("pos") % 7
    line = F.when(k == 2, F.concat(F.lit("--- Slide "), _number("pos"), F.lit(" ---"))).when(k == 3, F.concat(F.lit("[00:05] "), "line")).when(k == 5, " LEZIONE - PRIMA PARTE").when(k == 6, "[01:02]").otherwise(F.col("line"))
    return rows.withColumn("line", line)


@query("section_parse", rf"""
with {MARKED},
t as (select *, regexp_replace(line, '^\s+|\s+$', '', 'g') as s from m),
r as (select doc_id, i, case when regexp_matches(s, '^\[\d\d:\d\d\]') then trim(s[8:]) else line end as line, regexp_matches(s, '^\[\d\d:\d\d\]') as stamped,
  case when regexp_matches(s, '(?i)^---\s*(?:SLIDE|PAG)\s*(\d+)\s*---$') then 'Slide / Pagina ' || regexp_extract(s, '(\d+)', 1)
    when regexp_matches(s, '^[A-Z][A-Z\s\-:]{{8,}}$') and length(s) > 10 then array_to_string(list_transform(regexp_extract_all(s, '[A-Z]+|[^A-Z]+'), lambda w: w[1] || lower(w[2:])), '') end as h from t),
k as (select *, sum(case when h is not null then 1 else 0 end) over (partition by doc_id order by i) as sid from r where not stamped or line <> ''),
g as (select doc_id, cast(sid as bigint) as sid, max(h) as heading, coalesce(regexp_replace(string_agg(case when h is null then line end, chr(10) order by i), '^\s+|\s+$', '', 'g'), '') as body from k group by doc_id, sid)
select * from g where heading is not null or body <> ''""")
def section_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.parse_sections(_marked(spark, sf_dir), "doc_id", "pos", "line")


@query("section_titles", r"""
with l as (select doc_id, i, case when i % 6 = 3 then '2.' || i || '. Un titolo numerato' else line end as line
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)),
n as (select *, trim(line) as s, lead(line) over (partition by doc_id order by i) as nxt, regexp_replace(line, '[^\p{L}]', '', 'g') as alpha from l),
h as (select doc_id, i, line, case when s <> '' and case when alpha <> '' and alpha = upper(alpha) and not regexp_matches(alpha, '[\p{Ll}\p{Lo}\p{Lm}]') then length(s) <= 150 when length(s) > 100 then false
  else coalesce(trim(nxt) = '' and len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) >= 3, false) or regexp_matches(s, '^(?:[A-Z]|(?:\d+\.)*\d+)[.)]\s+[\p{L}\p{N}_]') end then s end as h from n),
k as (select *, sum(case when h is not null then 1 else 0 end) over (partition by doc_id order by i) as sid from h),
g as (select doc_id, cast(sid as bigint) as sid, max(h) as heading, coalesce(regexp_replace(string_agg(case when h is null then line end, chr(10) order by i), '^\s+|\s+$', '', 'g'), '') as body from k group by doc_id, sid)
select * from g where heading is not null or body <> ''""")
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.explode_lines(_documents(spark, sf_dir), "doc_id", "text")
    rows = rows.withColumn("line", F.when(F.col("pos") % 6 == 3, F.concat(F.lit("2."), _number("pos"), F.lit(". Un titolo numerato"))).otherwise(F.col("line")))
    return sequence.title_sections(rows, "doc_id", "pos", "line")


@query("math_extract", r"""
select doc_id, replace(text, '$', '') || ' [FORMULA_1] mid [FORMULA_3] and $z^2$ [FORMULA_2]' as text, ['$$x_{' || doc_id || '}$$', '$$w' || chr(10) || 'w$$', '\begin{align*}y' || chr(10) || '\end{align*}', '$z^2$'] as formulas from documents""")
def math_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.replace("text", F.lit("$"), F.lit("")), F.lit(" $$x_{"), F.col("doc_id").cast("string"), F.lit("}$$ mid \\begin{align*}y\n\\end{align*} and $z^2$ $$w\nw$$"))
    return sequence.extract_math(_documents(spark, sf_dir).withColumn("text", text), "text").select("doc_id", "text", "formulas")


#: Objects of a slide made of a part.
def _objects() -> Column:
    none = F.lit(None).cast("string")
    one = lambda kind, content, found: F.struct(F.lit(kind).alias("obj_type"), content.alias("content"), found.alias("latex_result"))
    odd = F.col("p_size") % 2 == 1
    return F.array(one("omml_formula", F.col("p_name"), none), one("image", F.lit("i.png"), F.when(odd, F.lit(r"\alpha≤1"))), one("table", F.col("p_brand"), none), one("text", F.col("p_name"), none), one("text", F.concat("p_type", F.lit("\n- x & y")), none))


def _title() -> Column:
    return F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))


@query("slide_text", r"""
select p_partkey, '--- SLIDE ' || p_size || case when p_partkey % 3 = 0 then '' else ': ' || p_name end || ' ---' || chr(10) || '[FORMULA: ' || p_name || ']' || case when p_size % 2 = 1 then chr(10) || '[FORMULA: \alpha≤1]' else '' end ||
  chr(10) || '[TABELLA: ' || p_brand || ']' || chr(10) || p_name || chr(10) || p_type || chr(10) || '- x & y' || case when p_partkey % 4 = 0 then chr(10) || '[NOTE PRESENTER: nota]' else '' end as text,
  case when p_partkey % 3 = 0 then p_name || chr(10) else '' end || p_type || chr(10) || '- x & y' as fallback from part""")
def slide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = F.when(F.col("p_partkey") % 4 == 0, "nota").otherwise("")
    return _parts(spark, sf_dir).select("p_partkey", render.slide_objects_text(F.col("p_size"), _title(), _objects(), notes).alias("text"), render.slide_fallback(_title(), _objects()).alias("fallback"))


@query("slide_skeleton", f"""
with e as (select *, {escaped('p_name')} as a, {escaped('p_type')} as c from part)
select p_partkey, '\\subsection{{' || case when p_partkey % 3 = 0 then '' else a end || '}}' || case when p_partkey % 2 = 0 then chr(10) || '\\begin{{figure}}[H]' || chr(10) || '  \\centering' || chr(10) || '  \\includegraphics[width=\\textwidth]{{s.png}}' || chr(10) ||
  '  \\caption{{' || case when p_partkey % 3 = 0 then '' else a end || '}}' || chr(10) || '\\end{{figure}}' || chr(10) else '' end || case when p_size % 2 = 1 then chr(10) || '\\begin{{equation}}' || chr(10) || '\\alpha\\leq 1' || chr(10) || '\\end{{equation}}' else '' end ||
  chr(10) || p_brand || case when p_partkey % 3 = 0 then chr(10) || a else '' end || chr(10) || c || chr(10) || '\\begin{{itemize}}' || chr(10) || '  \\item x \\& y' || chr(10) || '\\end{{itemize}}' as tex from e""")
def slide_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.when(F.col("p_partkey") % 2 == 0, F.lit("s.png"))
    return _parts(spark, sf_dir).select("p_partkey", render.skeleton(_title(), _objects(), image).alias("tex"))


@query("lesson_skeleton", """
with s as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, case l_returnflag when 'R' then 'SCHELETRO' when 'A' then 'SUPPORTO' else 'CARNE' end as role, case when l_linenumber = 3 then '' else l_returnflag || l_partkey end as t from lineitem),
h as (select *, bool_or(role = 'SCHELETRO' and t <> '') over (partition by l_orderkey) as has from s)
select l_orderkey, string_agg(t, chr(10) || chr(10) order by l_linenumber, t) as tex from h where t <> '' and role = case when has then 'SCHELETRO' else 'SUPPORTO' end group by l_orderkey""")
def lesson_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    role = F.when(F.col("l_returnflag") == "R", "SCHELETRO").when(F.col("l_returnflag") == "A", "SUPPORTO").otherwise("CARNE")
    text = F.when(F.col("l_linenumber") == 3, "").otherwise(F.concat("l_returnflag", F.col("l_partkey").cast("string")))
    return render.lesson_skeleton(l.select("l_orderkey", "l_linenumber", role.alias("role"), text.alias("t")), "l_orderkey", "role", "l_linenumber", "t")


#: Stands for a part's size in the formulas below.
SIZE = "§"


def _math(name: str, *inner: str) -> str:
    return f"<m:{name}>{''.join(inner)}</m:{name}>"


def _run(text: str) -> str:
    return _math("r", _math("t", text))


def _arg(text: str) -> str:
    return _math("e", _run(text))


def _pr(name: str, **values: str) -> str:
    return _math(f"{name}Pr", *[f'<m:{k} m:val="{v}"/>' for k, v in values.items()])


_SCRIPT = "'||case when length(p_size::varchar) = 1 then p_size::varchar else '{'||p_size||'}' end||'"
_LINE = "'||chr(10)||'"
#: A formula for each kind of element, with the LaTeX of it as SQL.
def _styled(style: str, text: str) -> str:
    return f"<m:r><m:rPr>{style}</m:rPr><m:t>{text}</m:t></m:r>"


SHAPES = [
    (_math("sSup", _arg("x"), _math("sup", _run(SIZE))), f"x^{_SCRIPT}"),
    (_math("sSub", _arg("x"), _math("sub", _run(SIZE))), f"x_{_SCRIPT}"),
    (_math("sSubSup", _arg("x"), _math("sub", _run("a")), _math("sup", _run(SIZE))), f"x_a^{_SCRIPT}"),
    (_math("sPre", _math("sub", _run("a")), _math("sup", _run(SIZE)), _arg("X")), f"^{_SCRIPT}_aX"),
    (_math("nary", _pr("nary", chr="∫", limLoc="undOvr"), _math("sub", _run("0")), _math("sup", _run(SIZE)), _arg("x")), r"\int_{0}^{§} x"),
    (_math("nary", _pr("nary", limLoc="subSup"), _math("sub", _run("0")), _math("sup", _run(SIZE)), _arg("x")), rf"\sum_0^{_SCRIPT} x"),
    (_math("func", _math("fName", _run("sin")), _arg(SIZE)), r"\sin\left(§\right)"),
    (_math("func", _math("fName", _run("rank")), _arg(SIZE)), r"\operatorname{rank}\left(§\right)"),
    (_math("limLow", _arg("lim"), _math("lim", _run(SIZE))), "lim_{§}"),
    (_math("limUpp", _arg("A"), _math("lim", _run(SIZE))), "A^{§}"),
    (_math("d", _pr("d", begChr="[", endChr="]"), _arg("x")), r"\left[x\right]"),
    (_math("d", _arg("a"), _arg(SIZE)), r"\left(a , §\right)"),
    (_math("m", _math("mr", _arg("a"), _arg(SIZE)), _math("mr", _arg("b"), _arg("c"))), rf"\begin{{pmatrix}}{_LINE}a & § \\{_LINE}b & c{_LINE}\end{{pmatrix}}"),
    (_math("eqArr", _arg("a"), _arg(SIZE)), rf"\begin{{aligned}}{_LINE}a \\{_LINE}§{_LINE}\end{{aligned}}"),
    (_math("bar", _pr("bar", pos="bot"), _arg(SIZE)), r"\underline{§}"),
    (_math("acc", _pr("acc", chr="\u0303"), _arg(SIZE)), r"\tilde{§}"),
    (_math("groupChr", _pr("groupChr", chr="⏟", pos="bot"), _arg(SIZE)), r"\underbrace{§}"),
    (_math("borderBox", _arg(SIZE)), r"\boxed{§}"),
    (_math("phant", _arg(SIZE)), r"\phantom{§}"),
    (_run("α ≤  §…"), r"\alpha \leq §\ldots"),
    (_math("unknown", _run(SIZE), _math("f", _math("num", _run("1")), _math("den", _run(SIZE)))), r"§\frac{1}{§}"),
    (_math("rPr", _run(SIZE)), "§"),
    (_styled('<m:sty m:val="p"/>', "ab"), r"\mathrm{ab}"),
    (_styled('<m:nor/>', "cd") + _run(SIZE), r"\mathrm{cd}§"),
    (_styled('<m:sty m:val="b"/>', SIZE), r"\mathbf{§}"),
    (_styled('<m:sty m:val="bi"/>', "v"), r"\boldsymbol{v}"),
    (_styled('<m:sty m:val="p"/>', SIZE), "§"),
]


@query("omml_shapes", f"select p_partkey, case p_partkey % {len(SHAPES)} " + " ".join(f"when {k} then '{want.replace(SIZE, chr(39) + '||p_size||' + chr(39))}'" for k, (_, want) in enumerate(SHAPES)) + " end as tex from part")
def omml_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as formulas of every kind of element; each distinct formula is converted once."""
    ship(spark)
    every = F.array(*[F.lit(f'<m:oMath xmlns:m="{formulas.MATH}">{xml}</m:oMath>') for xml, _ in SHAPES])
    xml = F.replace(F.element_at(every, (F.col("p_partkey") % len(SHAPES) + 1).cast("int")), F.lit(SIZE), F.col("p_size").cast("string"))
    return formulas.convert(_parts(spark, sf_dir).select("p_partkey", xml.alias("xml")), "xml", "tex").select("p_partkey", "tex")


@query("subjects", subject_sql("select doc_id, text || ' ' || ['sistema di controllo', 'il teorema e la dimostrazione', 'forza ed energia', 'il paziente e la diagnosi', 'mercato e prezzo', 'decreto e sentenza'][doc_id % 6 + 1] as t from documents", classify.KEYWORDS))
def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in ("sistema di controllo", "il teorema e la dimostrazione", "forza ed energia", "il paziente e la diagnosi", "mercato e prezzo", "decreto e sentenza")]), (F.col("doc_id") % 6 + 1).cast("int"))
    t = F.concat("text", F.lit(" "), said)
    return _documents(spark, sf_dir).select("doc_id", classify.subject(t).alias("subject"), F.array_max(classify.subject_scores(t)).score.alias("score"))


FILLERS = ("come già detto", "Come abbiamo visto, x", "in altre  parole", "è importante notare", "cioè a dire", "let us now consider", "in this lecture we", "so, basically", "a line that stays", "commento")


@query("fillers", f"""
with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda l, i: case when i % 2 = 0 then {list(FILLERS)}[i // 2 % {len(FILLERS)} + 1] else l end) as ls from documents)
select doc_id, array_to_string(list_filter(ls, lambda l: not regexp_matches(l, '(?i)(come\\s+(già\\s+)?(detto|visto|accennato)|come\\s+(vedremo|abbiamo\\s+visto)|in\\s+altre\\s+parole|importante\\s+(notare|sottolineare)|cioè\\s+a\\s+dire|let(''s| us)\\s+(now\\s+)?(look at|consider|see)|in\\s+this\\s+(slide|lecture)\\s+we|so,?\\s+(basically|essentially|fundamentally))')), chr(10)) as text from l""")
def fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in FILLERS])
    put = lambda line, i: F.when(i % 2 == 1, F.element_at(words, (F.floor((i + 1) / 2) % len(FILLERS) + 1).cast("int"))).otherwise(line)
    return _documents(spark, sf_dir).select("doc_id", T.drop_fillers(F.array_join(F.transform(lines(F.col("text")), put), "\n")).alias("text"))


@query("rtf_plain", r"""
with r as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('{\rtf1\ansi{\fonttbl x}' || replace(text, chr(10), '\par ') || '\line caff\''e8 \''93fine\''94}', '\\\n', chr(10), 'g'), '\\par\b', chr(10), 'g'), '\\line\b', chr(10), 'g'), '\\\\\s?', '', 'g'),
  '\\[a-z]+-?\d*\s?', '', 'g'), '\{[^{}]{0,200}\}', '', 'g'), '[{}]', '', 'g') as t from documents)
select doc_id, regexp_replace(regexp_replace(replace(replace(replace(t, '\''e8', 'è'), '\''93', '“'), '\''94', '”'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from r""")
def rtf_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl x}"), F.replace("text", F.lit("\n"), F.lit("\\par ")), F.lit("\\line caff\\'e8 \\'93fine\\'94}"))
    return _documents(spark, sf_dir).select("doc_id", T.strip_rtf(raw).alias("text"))


@query("page_blocks", """
with b as (select l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus as t, l_linenumber * 20.0 as y0, l_linenumber * 20.0 + case when l_partkey % 2 = 0 then 5 else 12 end as y1 from lineitem),
f as (select *, coalesce(y0 - lag(y1) over (partition by l_orderkey order by y0, l_partkey, y1, t) > 10, false) as far from b)
select l_orderkey, string_agg(case when far then chr(10) else '' end || t, chr(10) order by y0, l_partkey, y1, t) as text from f group by l_orderkey""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    y0 = F.col("l_linenumber") * 20.0
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("x0"), y0.alias("y0"), (y0 + F.when(F.col("l_partkey") % 2 == 0, 5).otherwise(12)).alias("y1"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return sequence.block_text(b, "l_orderkey")


@query("lesson_prompt", f"""
with d as (select doc_id, trim(regexp_replace(translate(text, chr(10) || '$-', '   '), '\\s+', ' ', 'g')) as t from documents),
c as (select doc_id, {TRIM.format(noise_sql('t'))} as t from d where t <> ''), s as (select * from ({subject_sql("select doc_id, ' ' || left(t, 2000) as t from c", classify.KEYWORDS)})),
x as (select c.doc_id, s.subject, '[TRASCRIZIONE]' || chr(10) || t as body from c join s on c.doc_id = s.doc_id where t <> '')
select doc_id, subject, body as clean_text, greatest(1, length(body) // 3) as tokens, case when length(body) // 3 > 80000 then 'DENSE' else 'RAW_CLEAN' end as mode,
  'TIPO DI CORSO: ' || subject || chr(10) || chr(10) || '# Doc ' || doc_id || chr(10) || chr(10) || body as prompt from x""")
def lesson_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library path from a raw transcript of one line to its prompt."""
    t = F.trim(F.regexp_replace(F.translate("text", "\n$-", "   "), r"\s+", " "))
    none = F.lit("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), t.alias("transcript"), none.alias("slides"), none.alias("extra"), none.alias("hint"), none.alias("context")).where("transcript <> ''")
    out = normalize(d, "doc_id").where("raw <> ''")
    return out.select("doc_id", "subject", "clean_text", "tokens", "mode", "prompt")


TRANSCRIPT = noise_sql("case when timed then '[00:10] ' || one || chr(10) || '[00:20] Poi basta.' else one || chr(10) || 'Poi basta.' end")


@query("lesson_full", f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, trim(regexp_replace(translate(text, chr(10) || '$-', '   '), '\\s+', ' ', 'g')) as t from documents),
r as (
  select *, 'Prima ' || t as one, doc_id % 2 = 0 as timed, case when doc_id % 3 = 0 then 'Nota di ' || source else '' end as ex,
    case when doc_id % 2 = 0 then '--- SLIDE 1: Titolo ' || doc_id || ' ---' || chr(10) || 'Corpo uno' || chr(10) || '--- SLIDE 2: Fine ---' || chr(10) || 'Corpo due ' || lang else '' end as sl from d where t <> ''),
c as (select *, {TRIM.format(f"regexp_replace({TRANSCRIPT}, '[^[:^space:]]+' || chr(10), chr(10), 'g')").replace("[^[:^space:]]+", "[ " + chr(92) + "t]+")} as tr from r),
s as (select * from ({subject_sql("select doc_id, left(sl, 3000) || ' ' || left(tr, 2000) as t from c", classify.KEYWORDS)})),
b as (
  select c.*, case when c.doc_id % 5 = 0 then 'fisica' else s.subject end as told,
    case when sl <> '' then '[SLIDE]' || chr(10) || {TRIM.format("sl")} || chr(10) || chr(10) else '' end || '[TRASCRIZIONE]' || chr(10) || tr || case when ex <> '' then chr(10) || chr(10) || '[DOCUMENTI]' || chr(10) || ex else '' end as body
  from c join s on c.doc_id = s.doc_id)
select doc_id, told as subject, body as clean_text, greatest(1, length(body) // 3) as tokens, case when length(body) // 3 > 80000 then 'DENSE' else 'RAW_CLEAN' end as mode,
  case when doc_id % 7 = 0 then 'CTX' || chr(10) || chr(10) else '' end || 'TIPO DI CORSO: ' || told || chr(10) || chr(10) ||
  case when timed then '## CONTENUTO LEZIONE (slide + spiegazione orale allineate)' || chr(10) || chr(10) || chr(10) || '### Slide 1: Titolo ' || doc_id || chr(10) || '[CONTENUTO SLIDE]' || chr(10) || 'Corpo uno' || chr(10) || '[SPIEGAZIONE ORALE]' || chr(10) || one || chr(10) || chr(10) ||
    '### Slide 2: Fine' || chr(10) || '[CONTENUTO SLIDE]' || chr(10) || trim('Corpo due ' || lang) || chr(10) || '[SPIEGAZIONE ORALE]' || chr(10) || 'Poi basta.' || chr(10)
  else '# Doc ' || doc_id || chr(10) || chr(10) || body end as prompt from b""")
def lesson_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library path with all inputs: stamped transcripts held against slides, or plain ones without; other documents, hints and context."""
    key, empty_ = F.col("doc_id"), F.lit("")
    t = F.trim(F.regexp_replace(F.translate("text", "\n$-", "   "), r"\s+", " "))
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", empty_).alias("lang"), F.coalesce("source", empty_).alias("source"), t.alias("t")).where("t <> ''")
    timed, number = key % 2 == 0, key.cast("string")
    said = F.when(timed, F.concat(F.lit("[00:10] Prima "), "t", F.lit("\n[00:20] Poi basta."))).otherwise(F.concat(F.lit("Prima "), "t", F.lit("\nPoi basta.")))
    deck = F.when(timed, F.concat(F.lit("--- SLIDE 1: Titolo "), number, F.lit(" ---\nCorpo uno\n--- SLIDE 2: Fine ---\nCorpo due "), "lang")).otherwise(empty_)
    lessons = d.select(
        "doc_id", F.concat(F.lit("Doc "), number).alias("title"), said.alias("transcript"), deck.alias("slides"), F.when(key % 3 == 0, F.concat(F.lit("Nota di "), "source")).otherwise(empty_).alias("extra"),
        F.when(key % 5 == 0, "fisica").otherwise(empty_).alias("hint"), F.when(key % 7 == 0, "CTX").otherwise(empty_).alias("context"),
    )
    return normalize(lessons, "doc_id").select("doc_id", "subject", "clean_text", "tokens", "mode", "prompt")

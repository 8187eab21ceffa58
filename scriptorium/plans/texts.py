"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import latex
from scriptorium.functions import text as T
from scriptorium.functions.pyre import lines
from scriptorium.operators import classify, merge, sequence
from scriptorium.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def sql_text(text: str) -> str:
    """A literal of SQL, line ends as chr(10)."""
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n"))


def sql_map(table: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


#: Documents broken into lines of five words, with noise put in, so that cleaning has work to do.
WRAPPED = """select doc_id, 'pag. 3' || chr(10) || '[00:05] ' || array_to_string(list_transform(string_split_regex(text, '[ \\n]+'), lambda w, i: case when i % 5 = 0 then w || chr(10) else w || ' ' end), '') || chr(10) || '12' || chr(10) || 'slide 3 / 9' as text from documents"""


def wrapped(docs: DataFrame) -> DataFrame:
    words = F.transform(F.split("text", "[ \n]+"), lambda w, i: F.concat(w, F.when(i % 5 == 4, F.lit("\n")).otherwise(F.lit(" "))))
    return docs.select("doc_id", F.concat(F.lit("pag. 3\n[00:05] "), F.array_join(words, ""), F.lit("\n12\nslide 3 / 9")).alias("text"))


NOISE = (r"(?i)\bpag(?:ina|\.?)?\s*\d+\b", r"(?m)^\s*\d+\s*$", r"(?m)^\s*[-–—]+\s*$", r"\[\d{2}:\d{2}\]\s*", r"©.*?(?:\n|$)", r"(?i)slide\s+\d+\s*/\s*\d+", r"(?i)department\s+of\s+\w+.*?\n", r"(?i)university\s+of\s+\w+.*?\n", r"(?i)a\.y\.\s*\d{4}[-/]\d{2,4}.*?\n")


def noise_sql(text: str) -> str:
    for p in NOISE:
        text = f"regexp_replace({text}, '{p}', '', 'g')"
    return text


@query("clean_text", f"""
with w as ({WRAPPED}), n as (select doc_id, list_transform(string_split({noise_sql('text')}, chr(10)), lambda l: [regexp_replace(l, '\\s+$', '')]) as ls from w),
j as (select doc_id, list_reduce(ls, lambda a, b: case when regexp_matches(b[1], '^\\p{{Ll}}') and a[len(a)] <> '' and not regexp_matches(a[len(a)], '[.!?:;)\\]"]$') and length(a[len(a)]) < 80
  then list_concat(a[1:len(a) - 1], [a[len(a)] || ' ' || b[1]]) else list_concat(a, b) end) as ls from n)
select doc_id, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as text from j""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapped(table(spark, sf_dir, "documents")).select("doc_id", T.clean(F.col("text")).alias("text"))


KEPT = """with l as (select doc_id, pos, line, regexp_replace(lower(line), '[^\\p{L}\\p{N}_]', '', 'g') as norm
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)),
k as (select *, row_number() over (partition by doc_id, norm order by pos) as r from l)"""


@query("dedup_lines", KEPT + " select doc_id, cast(pos as integer) as pos, line from k where r = 1 or length(norm) < 20")
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sequence.dedup_first(rows, ["doc_id"], "pos", "line")


DENSE, OUTLINE = 400, 1500


@query("token_mode", KEPT + f""", t as (select doc_id, string_agg(line, chr(10) order by pos) as text from k where r = 1 or length(norm) < 20 group by doc_id),
e as (select doc_id, greatest(1, length(regexp_replace(text, '\\\\[a-zA-Z]+', ' ', 'g')) // 3) + len(regexp_extract_all(text, '\\\\[a-zA-Z]+')) as tokens from t)
select lang, case when tokens > {OUTLINE} then 'OUTLINE' when tokens > {DENSE} then 'DENSE' else 'RAW_CLEAN' end as mode, count(*) as n_docs, cast(sum(tokens) as bigint) as tokens
from e join documents using (doc_id) group by all""")
def token_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines once, tokens counted, a mode chosen, by language. One exchange by document serves the join back."""
    docs = table(spark, sf_dir, "documents")
    kept = sequence.dedup_first(sequence.explode_lines(docs.select("doc_id", "lang", "text"), "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id"), ["doc_id"], "pos", "line")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    whole = kept.groupBy("doc_id", "lang").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("text"))
    d = whole.select("lang", T.token_estimate(F.col("text")).alias("tokens")).withColumn("mode", T.compression_mode(F.col("tokens"), None, DENSE, OUTLINE))
    return d.groupBy("lang", "mode").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))


@query("dedup_docs", "select min(doc_id) as doc_id, md5(text) as digest, count(*) as copies from documents group by md5(text)")
def dedup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.copies(table(spark, sf_dir, "documents"), "doc_id", "text")


WORDS = {"english": ("the", "and", "tion", "with"), "german": ("und", "der", "keit", "sch"), "french": ("que", "eau", "ment", "é"), "spanish": ("ción", "ñ", "que", "los")}


def subject_sql(rows: str, words: dict[str, tuple[str, ...]]) -> str:
    """rows: SQL of doc_id and t."""
    score = {k: " + ".join(f"cast(contains(t, '{w}') as int)" for w in ws) for k, ws in words.items()}
    best = "greatest(" + ", ".join(score.values()) + ")"
    arms = " ".join(f"when {s} = {best} then '{k}'" for k, s in score.items())
    return f"select doc_id, case when {best} < 2 then 'generico' {arms} end as subject, {best} as score from (select doc_id, lower(t) as t from ({rows}))"


@query("subject_score", subject_sql("select doc_id, left(text, 3000) as t from documents", WORDS))
def subject_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.substring("text", 1, 3000)
    return table(spark, sf_dir, "documents").select("doc_id", classify.subject(t, None, WORDS).alias("subject"), F.array_max(classify.subject_scores(t, WORDS)).score.alias("score"))


@query("text_density", "select doc_id, length(regexp_replace(text, '\\s', '', 'g')) / length(text) as density from documents")
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.density(F.col("text")).alias("density"))


@query("doubled_repair", "select doc_id, trim(translate(text, chr(10), ' ')) as text from documents")
def doubled_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, every other one with all its characters written twice."""
    line = F.trim(F.translate("text", "\n", " "))
    twice = F.regexp_replace(line, "(?s)(.)", "$1$1")
    return table(spark, sf_dir, "documents").select("doc_id", T.repair_doubled(F.when(F.col("doc_id") % 2 == 0, twice).otherwise(line)).alias("text"))


@query("latex_escape", f"select doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: coalesce({sql_map(latex.SPECIAL | latex.text_map())}[c], c)), '') as tex from documents")
def latex_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", latex.escape(F.col("text")).alias("tex"))


@query("formula_sanitize", f"select doc_id, array_to_string(list_transform(string_split(text || ' α≤β → 𝑥²', ''), lambda c: coalesce({sql_map(latex.formula_map())}[c], c)), '') as tex from documents")
def formula_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", latex.sanitize_formula(F.concat(F.col("text"), F.lit(" α≤β → 𝑥²"))).alias("tex"))


@query("babel_language", f"select lang, coalesce({sql_map(latex.BABEL)}[lang], lang) as babel, count(*) as n from documents group by all")
def babel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", latex.babel_name(F.col("lang")).alias("babel")).agg(F.count("*").alias("n"))


@query("inline_math", "select doc_id, f as formulas from (select doc_id, regexp_extract_all(replace(text, '$$', ''), '\\$[^$\\n]{2,120}\\$') as f from documents) where len(f) > 0")
def inline_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.extract_math(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("$$"), F.lit("")).alias("text")), "text").where(F.size("formulas") > 0).select("doc_id", "formulas")


@query("truncate_budget", """
with c as (select doc_id, text, 200 * (1 + doc_id % 3) as m, left(text, cast(200 * (1 + doc_id % 3) as int)) as cut from documents),
n as (select *, case when contains(cut, chr(10)) then length(cut) - strpos(reverse(cut), chr(10)) else -1 end as nl from c),
d as (select *, case when nl > m * 0.85 then left(cut, cast(nl as int)) else cut end as short from n)
select doc_id, case when length(text) <= m then text else short || chr(10) || chr(10) || '[... ' || format('{:,}', length(text) - length(short)) || ' caratteri omessi per rispettare il budget token ...]' end as text from d""")
def truncate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), (200 * (1 + F.col("doc_id") % 3)).cast("int")).alias("text"))


FILLERS = (r"\bque\b", r"\bund\b", r"\bwith\b")


@query("filler_filter", f"select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: not regexp_matches(l, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(que|und|with)($|[^\\p{{L}}\\p{{N}}_])')), chr(10)) as text from documents")
def filler_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.drop_fillers(F.col("text"), FILLERS).alias("text"))


@query("footer_filter", r"""
with t as (select page_id, [url, 'mail@example.org', ' 3 / 47 ', 'body of ' || url, '1/2 + 1'] as ls from pages)
select page_id, array_to_string(list_filter(ls, lambda l: not regexp_matches(l, '^\s*(?:[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}|https?://\S+|\d{1,4}\s*/\s*\d{1,4})\s*$')), chr(10)) as text from t""")
def footer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("\n", "url", F.lit("mail@example.org"), F.lit(" 3 / 47 "), F.concat(F.lit("body of "), "url"), F.lit("1/2 + 1"))
    return table(spark, sf_dir, "pages").select("page_id", T.drop_footers(text).alias("text"))


@query("plausible_formula", r"""
with t as (select doc_id, list_transform(string_split(text, ' '), lambda w: regexp_replace(w, '^\s+|\s+$', '', 'g')) as ws from documents)
select doc_id, len(ws) as n_words, len(list_filter(ws, lambda s: length(s) >= 2 and not regexp_matches(s, '^[.\s,;:]+$') and not regexp_matches(s, '^[a-zA-Z]{1,2}$') and not regexp_matches(s, '^\d+$') and not regexp_matches(s, '[^\x00-\x7F]{5,}')
  and regexp_matches(s, '[\\{}^_+=\-/*<>\p{L}\p{N}]'))) as n_plausible from t""")
def plausible_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each whole text could be a formula."""
    words = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.size(F.filter(words, T.plausible_latex)).cast("long").alias("n_plausible"))


@query("prompt_tokens", "select lang, count(*) as n, cast(sum((length(text) + 100) // 4) as bigint) as tokens from documents group by lang")
def prompt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(T.prompt_tokens(F.lit("x" * 100), F.col("text"))).alias("tokens"))


@query("dual_extract_pick", r"""
with a as (select doc_id, text from documents), b as (select doc_id, replace(text, ' ', case when doc_id % 2 = 0 then '   ' else '' end) as text from documents),
m as (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.text, '') as x, coalesce(b.text, '') as y from a full join b on a.doc_id = b.doc_id),
p as (select doc_id, case when coalesce(length(regexp_replace(x, '\s', '', 'g')) / nullif(length(regexp_replace(x, '  +', ' ', 'g')), 0), 0) >= coalesce(length(regexp_replace(y, '\s', '', 'g')) / nullif(length(y), 0), 0) then x else y end as t from m),
l as (select doc_id, list_transform(list_filter(string_split(t, chr(10)), lambda l: l = '' or not (length(trim(l)) < 5 and (length(l) - length(replace(l, ' ', ''))) / length(l) > 0.85)), lambda l: regexp_replace(regexp_replace(l, '  +', ' ', 'g'), '\s+$', '')) as ls from p),
j as (select doc_id, regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from l)
select doc_id, text, length(text) as chars_count from j where text <> ''""")
def dual_extract_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    gap = F.when(F.col("doc_id") % 2 == 0, F.lit("   ")).otherwise(F.lit(""))
    return merge.pick_denser(d.select("doc_id", "text"), d.select("doc_id", F.replace("text", F.lit(" "), gap).alias("text")), ["doc_id"], "text")


@query("sparse_enrich", """
with p as (select conv_id, turn, text as t from conversations), o as (select conv_id, turn + 1 as turn, 'ocr ' || text as o from conversations),
m as (select coalesce(p.conv_id, o.conv_id) as conv_id, coalesce(p.turn, o.turn) as turn, t, o from p full join o on p.conv_id = o.conv_id and p.turn = o.turn)
select conv_id, turn, case when t is null then o when length(t) < 80 and o is not null then t || chr(10) || o else t end as appended,
  case when t is null then o when length(t) < 80 and o is not null then o else t end as replaced from m""")
def sparse_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pages = c.select("conv_id", "turn", "text")
    ocr = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(F.lit("ocr "), "text").alias("text"))
    keys = ["conv_id", "turn"]
    a = merge.enrich_sparse(pages, ocr, keys, "text", True).select(*keys, F.col("text").alias("appended"))
    return a.join(merge.enrich_sparse(pages, ocr, keys, "text", False).select(*keys, F.col("text").alias("replaced")), keys)


@query("line_count", "select doc_id, len(string_split(text, chr(10))) as n_lines from documents")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines(F.col("text"))).alias("n_lines"))

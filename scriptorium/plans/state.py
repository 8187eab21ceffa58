"""Queries of lesson memory, jobs, files and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import latex
from scriptorium.operators import context, jobs, render, sequence
from scriptorium.plans.texts import query
from scriptorium.session import table
from scriptorium.sources import files


@query("context_prev", """
with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as number, o_orderpriority as p from orders)
select a.o_custkey, a.number, coalesce(string_agg('Lez. ' || b.number || ': ' || b.o_orderkey || ' → ' || b.p, chr(10) order by b.number), '') as before
from o a left join o b on a.o_custkey = b.o_custkey and b.number < a.number and b.number >= a.number - 5 group by a.o_custkey, a.number""")
def context_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("number"), F.array("o_orderpriority").alias("concepts"))
    line = lambda b: F.concat(F.lit("Lez. "), b.number.cast("string"), F.lit(": "), b.title.cast("string"), F.lit(" → "), F.array_join(b.concepts, ", "))
    d = context.previous(o, "o_custkey", "number", "o_orderkey", "concepts")
    return d.select("o_custkey", "number", F.array_join(F.transform("before", line), "\n").alias("before"))


@query("context_known", """
with o as (select o_custkey, o_orderpriority as p, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as number from orders),
f as (select o_custkey, p, min(number) as first from o group by all)
select o.o_custkey, o.number, coalesce(string_agg(f.p, ', ' order by f.first) filter (f.first < o.number), '') as known from o join f on o.o_custkey = f.o_custkey group by all""")
def context_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("number"), F.array("o_orderpriority").alias("concepts"))
    return context.known(o, "o_custkey", "number", "concepts").select("o_custkey", "number", F.array_join("known", ", ").alias("known"))


@query("context_upsert", """
with v as (select user_id, event_type, event_id, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as v from events),
l as (select user_id, event_type, event_id, value, row_number() over (partition by user_id order by event_type desc) as r from v where v = 1)
select user_id, event_type, event_id, case when r <= 3 then value end as value from l""")
def context_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    last = context.upsert(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return context.compact(last, "user_id", "event_type", ["value"], keep=3).select("user_id", "event_type", "event_id", "value")


@query("symbol_merge", """
with s as (select event_type, 'k' || (value * 100)::bigint % 80 as symbol, user_id, event_id from (select * from events where value is not null)),
g as (select event_type, symbol, max_by(user_id, event_id) as meaning, min(event_id) as place from s group by all)
select event_type, symbol, meaning, place from (select *, row_number() over (partition by event_type order by place desc) as r from g) where r <= 50""")
def symbol_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    s = e.select("event_type", F.concat(F.lit("k"), (F.round(F.col("value") * 100).cast("bigint") % 80).cast("string")).alias("symbol"), "user_id", "event_id")
    return context.merge_symbols(s, "event_type", "symbol", "user_id", F.col("event_id")).select("event_type", "symbol", "meaning", "place")


@query("concept_extract", r"""
select doc_id, 'Titolo ' || doc_id || '|Note' as concepts, 'Nome ' || lang as definitions, 'x_n=il valore di ' || lang as symbols,
  case when trim(translate(text, chr(10) || '{}', '   ')) = '' then 'Lezione 9' else trim(translate(text, chr(10) || '{}', '   ')) end as topic from documents""")
def concept_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.translate("text", "\n{}", "   ")
    tex = F.concat(F.lit(r"\section{Titolo "), F.col("doc_id").cast("string"), F.lit(r"} \subsection{Lezione 9}\subsection*{"), head, F.lit(r"}\begin{definition}[Nome "), "lang", F.lit(r"] corpo \end{definition} $x_n$ indica il valore di "), "lang", F.lit(r", e \subsection{Note}"))
    d = table(spark, sf_dir, "documents").select("doc_id", tex.alias("tex"))
    kept = F.transform(context.symbols(F.col("tex")), lambda s: F.concat_ws("=", s.symbol, s.meaning))
    return d.select("doc_id", F.array_join(context.concepts(F.col("tex")), "|").alias("concepts"), F.array_join(context.definitions(F.col("tex")), "|").alias("definitions"), F.array_join(kept, "|").alias("symbols"), context.last_topic(F.col("tex")).alias("topic"))


@query("numbering", "select o_custkey, count(*) + 1 as next_number, coalesce(case when o_custkey % 4 = 0 then 100 end, count(*) + 1) as start from orders group by o_custkey")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint").alias("number"))
    n = context.next_number(o, "o_custkey", "number")
    return n.select("o_custkey", "next_number", context.number_from(F.when(F.col("o_custkey") % 4 == 0, F.lit(100).cast("bigint")), F.col("next_number")).alias("start"))


@query("previous_chapter", "select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as lesson from orders group by o_custkey")
def previous_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("run"), F.array("o_orderkey").alias("lessons"))
    return context.previous_chapter(o, "o_custkey", "run", "lessons")


@query("insert_absent", "select user_id, max(n) as n from (select distinct user_id, 1 as n from events where event_type = 'click' union all select distinct user_id, 2 from events where event_type = 'view' and user_id not in (select user_id from events where event_type = 'click')) group by user_id")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    one = lambda kind, n: e.where(F.col("event_type") == kind).select("user_id").distinct().withColumn("n", F.lit(n))
    return context.insert_absent(one("click", 1), one("view", 2), ["user_id"])


@query("job_latest", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_state(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


STATUS = "case event_type when 'signup' then 'queued' when 'view' then 'running' when 'error' then 'error' else 'done' end"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(STATUS).alias("status"))


@query("job_evict", f"""
with j as (select event_id, user_id, ts, {STATUS} as status from events), g as (select event_id, row_number() over (order by ts, event_id) as r from j where status in ('done', 'error'))
select event_id, status from j where event_id not in (select event_id from g where r <= (select count(*) - 200 from j))""")
def job_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.evict(_jobs(spark, sf_dir), "status", ["ts", "event_id"]).select("event_id", "status")


@query("ttl_expire", f"select event_id from events where {STATUS} in ('done', 'error') and ts < (select max(ts) from events) - interval 7 day")
def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    now = j.agg(F.max("ts").alias("now"))
    return j.join(F.broadcast(now)).where(jobs.expired(F.col("status"), F.col("ts"), F.col("now"), F.lit(7))).select("event_id")  # one row


@query("admission", f"select user_id, count(*) filter ({STATUS} = 'running') as running, count(*) filter ({STATUS} = 'running') < 2 as admitted from events group by user_id")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.admits(_jobs(spark, sf_dir), ["user_id"], "status", 2)


@query("job_reload", f"select event_id, case when {STATUS} = 'running' then 'error' else {STATUS} end as status from events")
def job_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reload(_jobs(spark, sf_dir)).select("event_id", "status")


@query("job_status_view", f"""
with j as (select user_id, max_by({STATUS}, (ts, event_id)) as status from events group by user_id), p as (select user_id, cast(count(*) % 100 as integer) as progress, 'Passo ' || count(*) as current_step from events where event_type = 'click' group by user_id)
select j.user_id, status, coalesce(case when status in ('running', 'done') then progress end, case when status = 'done' then 100 else 0 end) as progress,
  coalesce(case when status in ('running', 'done') then current_step end, case status when 'queued' then 'In coda' when 'running' then '' when 'done' then 'Completato' else 'Errore' end) as current_step from j left join p on j.user_id = p.user_id""")
def job_status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs.latest_state(_jobs(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "status")
    p = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg((F.count("*") % 100).cast("int").alias("progress"), F.concat(F.lit("Passo "), F.count("*").cast("string")).alias("current_step"))
    return jobs.status_view(j, p, "user_id")


@query("job_orphans", "select o_custkey, 'Ordine' as title, 'done' as status from (select distinct o_custkey from orders) where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0)")
def job_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").select("o_custkey").distinct().withColumn("title", F.lit("Ordine"))
    return jobs.orphans(out, table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("batch_resume", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def batch_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.new_lessons(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("log_errors", """
with l as (select user_id, event_id, case when event_type = 'error' then '! ' else '' end || event_type as line, row_number() over (partition by user_id order by ts, event_id) as n from events),
x as (select *, lead(line, 1) over (partition by user_id order by n) as after1, lead(line, 2) over (partition by user_id order by n) as after2 from l)
select user_id, event_id, after1, after2, rank from (select *, row_number() over (partition by user_id order by n) as rank from x where line like '!%') where rank <= 10""")
def log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("event_type") == "error", "! ").otherwise(""), F.col("event_type"))
    return sequence.error_context(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], line).select("user_id", "event_id", "after1", "after2", "rank")


@query("ring_buffer", "select event_type, event_id, rank from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as rank from events) where rank <= 500")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.ring(table(spark, sf_dir, "events").select("event_type", "event_id", "ts"), "event_type", [F.col("ts").desc(), F.col("event_id").desc()]).select("event_type", "event_id", "rank")


@query("role_char_report", "select source, lang, count(*) as n_sources, cast(sum(length(text)) as bigint) as n_chars from documents group by rollup (source, lang)")
def role_char_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.role_report(table(spark, sf_dir, "documents"), ["source", "lang"], "text")


@query("run_listing", """
with o as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select o_custkey, '\\part{Parte ' || o_custkey || '}' || chr(10) || string_agg('\\input{lezione_' || lpad(n::varchar, cast(greatest(2, length(n::varchar)) as integer), '0') || '}', chr(10) order by n) as tex from o group by o_custkey""")
def run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    return render.run_file(o, "o_custkey", "n")


@query("main_listing", "select o_orderpriority, string_agg('\\include{run_' || k || '}', chr(10) order by 'run_' || k) as tex from (select o_orderpriority, o_custkey % 30 as k from orders group by all) group by o_orderpriority")
def main_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.concat(F.lit("run_"), (F.col("o_custkey") % 30).cast("string")).alias("stem")).distinct()
    return render.main_file(o, "o_orderpriority", "stem")


@query("figure_blocks", "select page_id, '\\begin{figure}[H]' || chr(10) || '  \\centering' || chr(10) || '  \\includegraphics[width=\\textwidth]{p' || page_id || '.png}' || chr(10) || '  \\caption{Pagina ' || page_id || '}' || chr(10) || '\\end{figure}' || chr(10) as tex from pages")
def figure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", latex.figure(F.concat(F.lit("p"), k, F.lit(".png")), F.concat(F.lit("Pagina "), k)).alias("tex"))


@query("url_clean", r"""
select page_id, regexp_replace(u, '&altTranscode=1(.|\n)*$', '') as cut, regexp_replace(u, '[?&]altTranscode=1(&|$)', '\1') as dropped, regexp_matches(u, '(?i)^https?://[^/]*(example\.org)') as known
from (select page_id, case when contains(url, '?') then url || '&altTranscode=1&x=' || page_id else url || '?altTranscode=1&x=1' end as u from pages)""")
def url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when(F.contains("url", F.lit("?")), F.concat("url", F.lit("&altTranscode=1&x="), F.col("page_id").cast("string"))).otherwise(F.concat("url", F.lit("?altTranscode=1&x=1")))
    return table(spark, sf_dir, "pages").select("page_id", files.cut_url(u).alias("cut"), files.drop_parameter(u).alias("dropped"), files.known_host(u, r"example\.org").alias("known"))


@query("magic_check", """
select page_id, case when page_id % 4 = 0 then null when page_id % 4 = 1 then '.pdf' when page_id % 4 = 2 then null else '.mp4,.m4a,.m4v,.mov' end as expected from pages""")
def magic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("page_id") % 4).cast("int")
    head = F.when(kind == 0, F.encode(F.substring("html", 1, 8), "UTF-8")).when(kind == 1, F.encode(F.lit("%PDF-1.7"), "UTF-8")).when(kind == 2, F.unhex(F.lit("504B030400000000"))).otherwise(F.encode(F.lit("\u0001\u0001\u0001\u0001ftyp"), "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", files.magic_problem(F.when(kind == 2, "a.pptx").otherwise("a.html"), head).alias("expected"))


@query("upload_check", "select o_orderkey, case when o_orderkey % 5 = 4 then 'extension' when o_orderkey % 3 = 0 then 'empty' when o_orderkey % 7 = 0 then 'too large' end as problem from orders")
def upload_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("f."), F.element_at(F.array(*[F.lit(x) for x in ("pdf", "MP3", "docx", "txt", "exe")]), (k % 5 + 1).cast("int")))
    size = F.when(k % 3 == 0, F.lit(0).cast("bigint")).when(k % 7 == 0, F.lit(files.LARGEST + 1)).otherwise(F.lit(5).cast("bigint"))
    return table(spark, sf_dir, "orders").select("o_orderkey", files.upload_problem(name, size).alias("problem"))


@query("settings_guard", "select event_id, case when event_id % 3 = 0 and event_id % 12 between 1 and 10 then cast(event_id % 12 as integer) else 2 end as value from events")
def settings_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 12).cast("string")).otherwise("many")
    return table(spark, sf_dir, "events").select("event_id", jobs.guarded(raw, 1, 10, F.lit(2)).alias("value"))


@query("heartbeat", "select event_id, 10 + least((event_id % 100) / 50.0, 0.95) * 30 as progress from events")
def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jobs.heartbeat(F.lit(10.0), F.lit(40.0), (F.col("event_id") % 100).cast("double"), F.lit(50.0)).alias("progress"))


@query("props_counters", "select event_id, cast(json_extract(props, '$.k') as integer) as k from events")
def props_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.element_at(files.counters(F.col("props")), "k").alias("k"))


@query("page_skeleton", """
select page_id, chr(10) || case when page_id % 2 = 0 then '\\subsection{Titolo ' || page_id || '}' else '\\subsection*{Pagina ' || page_id || '}' end || '\\label{subsec:doc-pag' || lpad(page_id::varchar, cast(greatest(3, length(page_id::varchar)) as integer), '0') || '}' || chr(10) || chr(10) || 'corpo' || chr(10) as tex from pages""")
def page_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    sections = F.array(F.struct(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Titolo "), k)).otherwise("").alias("heading"), F.lit("corpo").alias("body")))
    return table(spark, sf_dir, "pages").select("page_id", render.page_skeleton(F.col("page_id"), F.lit(None).cast("string"), sections, F.lit("doc")).alias("tex"))


@query("content_blobs", "select md5(html) as md5, max(strlen(html)) as n_bytes from pages group by md5(html)")
def content_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = files.content_table(table(spark, sf_dir, "pages").select(F.encode("html", "UTF-8").alias("content")))
    return blobs.select("md5", F.octet_length("content").cast("long").alias("n_bytes"))

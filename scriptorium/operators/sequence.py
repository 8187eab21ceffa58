"""Operators on ordered lines, segments and pages. Every row carries its position; nothing relies on arrival order.

All windows of one pack partition by the document or lesson key, so one exchange serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.pyre import strip, title_case

#: Limits, and the patterns of stamps, markers and formulas.
PAUSE_CAP = 45
CHUNK, CHUNK_OVER = 7, 20
STAMP = r"(?mdU)^\[(\d{1,2}:\d{2}(?::\d{2})?)\]\s*(.+)$"
LONG_STAMP = r"(?mdU)^\[(\d{1,3}:\d{2}(?::\d{2})?)\]\s*(.+)$"
MARKER = r"(?mdU)^---\s*(?:SLIDE|slide)\s*(\d+)(?:\s*:\s*(.+?))?\s*---\s*$"


def explode_lines(docs: DataFrame, key: str, text: str, sep: str = "\n") -> DataFrame:
    """key, pos, line."""
    return docs.select(key, F.posexplode_outer(F.split(text, sep)).alias("pos", "line")).where(F.col("line").isNotNull())


def implode(rows: DataFrame, key: str, pos: str, value: str, out: str, sep: str = "\n") -> DataFrame:
    """Values joined in the order of pos."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, value)))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[value]), sep).alias(out))


def parse_transcript(docs: DataFrame, key: str, text: Column, long_minutes: bool = False) -> DataFrame:
    """key, seq, time_sec, text of the stamped lines; long_minutes also takes minutes of three digits."""
    pattern = F.lit(LONG_STAMP if long_minutes else STAMP)
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("at"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("said"))
    rows = docs.select(key, F.posexplode_outer(both).alias("seq", "s")).where(F.col("s").isNotNull())
    part = lambda i: F.get(F.split("s.at", ":"), F.lit(i)).cast("int")
    seconds = F.when(F.size(F.split("s.at", ":")) == 3, part(0) * 3600 + part(1) * 60 + part(2)).otherwise(part(0) * 60 + part(1))
    return rows.select(key, "seq", seconds.alias("time_sec"), strip(F.col("s.said")).alias("text"))


def parse_slides(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, slide_pos, slide_num, title, body of marked slides."""
    marks = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    bodies = F.split(text, MARKER, -1)
    rows = docs.select(key, F.posexplode_outer(F.arrays_zip(marks.alias("m"), F.slice(bodies, F.lit(2), F.size(marks)).alias("b"))).alias("slide_pos", "s")).where(F.col("s").isNotNull())
    return rows.select(key, "slide_pos", F.regexp_extract("s.m", MARKER, 1).cast("int").alias("slide_num"), strip(F.regexp_extract("s.m", MARKER, 2)).alias("title"), strip(F.col("s.b")).alias("body"))


def align_timed(segments: DataFrame, key: str, order: list[str], time: str, slides: Column) -> DataFrame:
    """Adds idx: the slide that a segment was spoken on, by share of speaking time; gaps count at most PAUSE_CAP seconds."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.least(F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0)), F.lit(PAUSE_CAP))
    d = segments.withColumn("_gap", gap).withColumn("speech", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.greatest(F.lit(1.0), F.last("speech").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double"))
    idx = F.floor(F.col("speech") / total * slides)
    return d.withColumn("idx", F.greatest(F.lit(0), F.least(slides - 1, idx)).cast("int")).drop("_gap")


def align_uniform(rows: DataFrame, key: str, order: list[str], slides: Column) -> DataFrame:
    """Adds idx: equal runs of lines to the slides, the rest to the last."""
    w = Window.partitionBy(key)
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / slides))
    place = F.row_number().over(w.orderBy(*order)) - 1
    return rows.withColumn("idx", F.least(slides - 1, F.floor(place / size)).cast("int"))


def aligned_blocks(slides: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Slides with their segments (array of time_sec, text); a key without slides gets one block 0. segments: key, seq, time_sec, text, idx."""
    said = segments.groupBy(key, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "time_sec", "text"))), lambda s: F.struct(s.time_sec.alias("time_sec"), s.text.alias("text"))).alias("said"))
    none = F.expr("cast(array() as array<struct<time_sec:int,text:string>>)")
    with_slides = slides.join(said.withColumnRenamed("idx", "slide_pos"), [key, "slide_pos"], "left").withColumn("said", F.coalesce("said", none))
    alone = segments.join(slides.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "time_sec", "text"))), lambda s: F.struct(s.time_sec.alias("time_sec"), s.text.alias("text"))).alias("said"))
    alone = alone.select(key, F.lit(0).alias("slide_pos"), F.lit(0).alias("slide_num"), F.lit("Trascrizione").alias("title"), F.lit("").alias("body"), "said")
    return with_slides.select(key, "slide_pos", "slide_num", "title", "body", "said").unionByName(alone)


def render_block(num: Column, title: Column, body: Column, said: Column) -> Column:
    oral = F.filter(F.transform(said, lambda s: s.text), lambda t: strip(t) != "")
    head = F.concat(F.lit("### Slide "), num.cast("string"), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(F.lit("")))
    parts = F.array(head, F.when(strip(body) != "", F.concat(F.lit("[CONTENUTO SLIDE]\n"), strip(body))), F.when(F.size(oral) > 0, F.concat(F.lit("[SPIEGAZIONE ORALE]\n"), F.array_join(oral, "\n"))), F.lit(""))
    return F.array_join(F.array_compact(parts), "\n")


def dedup_first(rows: DataFrame, key: list[str], pos: str, text: str, least: int = 20) -> DataFrame:
    """Of equal lines of a document (letters, digits and _ in lower case) the first stays; shorter ones than `least` all stay.

    A window over (key, hash) spreads a long document over many tasks, as it sorts only equal lines together.
    """
    norm = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")
    d = rows.withColumn("_norm", F.md5(norm)).withColumn("_short", F.length(norm) < least)
    first = F.min(F.when(~F.col("_short"), F.col(pos))).over(Window.partitionBy(*key, "_norm"))
    return d.withColumn("_first", first).where(F.col("_short") | (F.col(pos) == F.col("_first"))).drop("_norm", "_short", "_first")


def is_title(line: Column, following: Column) -> Column:
    """Title rules of one line, with the line after it (null at the end)."""
    t = strip(line)
    alpha = F.regexp_replace(t, r"[^\p{L}]", "")
    caps = (alpha != "") & (alpha == F.upper(alpha)) & ~alpha.rlike(r"[\p{Ll}\p{Lo}\p{Lm}]")
    apart = following.isNotNull() & (strip(following) == "") & (F.size(F.array_remove(F.split(t, r"(?U)\s+"), "")) >= 3)
    numbered = t.rlike(r"(?U)^(?:[A-Z]|(?:\d+\.)*\d+)[.)]\s+\w")
    return F.coalesce(F.when(t == "", False).when(caps, F.length(t) <= 150).when(F.length(t) > 100, False).otherwise(apart | numbered), F.lit(False))


def sections_by(rows: DataFrame, key: str, pos: str, line: str, heading: Column) -> DataFrame:
    """key, sid, heading, body: runs of lines up to the next heading; heading is a line's heading or null. Blank sections go."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_h", heading).withColumn("sid", F.sum(F.when(F.col("_h").isNotNull(), 1).otherwise(0)).over(w))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("_h").isNull(), F.struct(F.col(pos).alias("p"), F.col(line).alias("x"))))), lambda s: s.x)
    g = d.groupBy(key, "sid").agg(F.max("_h").alias("heading"), strip(F.array_join(body, "\n")).alias("body"))
    return g.where(F.col("heading").isNotNull() | (F.col("body") != ""))


def title_sections(rows: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """Sections by the title rules; a text without titles is one section."""
    d = rows.withColumn("_next", F.lead(line).over(Window.partitionBy(key).orderBy(pos)))
    return sections_by(d, key, pos, line, F.when(is_title(F.col(line), F.col("_next")), strip(F.col(line))))


def marked_heading(line: Column) -> Column:
    """Heading of a slide or page marker, or of a line in capitals."""
    t = strip(line)
    # must-match patterns of markers and of headings in capitals
    mark = r"(?iU)^---\s*(?:SLIDE|PAG)\s*(\d+)\s*---\s*$"
    caps = t.rlike(r"(?U)^[A-Z][A-Z\s\-:]{8,}$") & (F.length(t) > 10)
    return F.when(t.rlike(mark), F.concat(F.lit("Slide / Pagina "), F.regexp_extract(t, mark, 1))).when(caps, title_case(t))


def parse_sections(rows: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """Sections by markers and capitals; a time stamp before a line's text is dropped, and a line of a stamp alone."""
    stamp = r"(?d)^\[\d{2}:\d{2}\](.*)$"  # a must-match pattern
    t = strip(F.col(line))
    rest = F.when(t.rlike(stamp), strip(F.regexp_extract(t, stamp, 1))).otherwise(F.col(line))
    d = rows.withColumn("_stamped", t.rlike(stamp)).withColumn("_rest", rest).where(~F.col("_stamped") | (F.col("_rest") != ""))
    return sections_by(d, key, pos, "_rest", marked_heading(F.col(line)))


#: Must-match patterns: display formulas, environments and inline formulas.
DISPLAY = r"\$\$[\s\S]{2,2000}?\$\$"
ENVIRONMENT = r"\\begin\{(?:equation|align|gather|multline|cases|pmatrix|bmatrix|vmatrix|array)\*?\}[\s\S]*?\\end\{(?:equation|align|gather|multline|cases|pmatrix|bmatrix|vmatrix|array)\*?\}"
INLINE = r"(?d)\$[^$\n]{2,120}\$"


def _numbered(text: Column, pattern: str, before: Column) -> tuple[Column, Column]:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    mark = lambda g, i: F.when(i < F.size(found), F.concat(g, F.lit("[FORMULA_"), (i + before + 1).cast("string"), F.lit("]"))).otherwise(g)
    return F.when(F.size(found) > 0, F.array_join(F.transform(gaps, mark), "")).otherwise(text), found


def extract_math(docs: DataFrame, text: str) -> DataFrame:
    """Replaces display formulas by numbered marks and adds `formulas`: those, then the inline ones, which stay in the text."""
    body, display = _numbered(F.col(text), DISPLAY, F.lit(0))
    d = docs.withColumns({"_display": display, "_body": body})
    body, env = _numbered(F.col("_body"), ENVIRONMENT, F.size("_display"))
    d = d.withColumns({"_env": env, "_body": body})
    inline = F.regexp_extract_all("_body", F.lit(INLINE), F.lit(0))
    return d.withColumns({text: F.col("_body"), "formulas": F.concat("_display", "_env", inline)}).drop("_display", "_env", "_body")


def chunk_pages(pages: DataFrame, key: str, page: str, size: int = CHUNK, over: int = CHUNK_OVER, has_audio: Column | None = None) -> DataFrame:
    """Adds chunk (by rank of page, null if the document is not chunked)."""
    w = Window.partitionBy(key)
    many = F.count("*").over(w) > over
    if has_audio is not None:
        many &= ~has_audio
    return pages.withColumn("chunk", F.when(many, F.floor((F.row_number().over(w.orderBy(page)) - 1) / size).cast("int")))


def chunk_texts(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """key, chunk, first, last, n, title, text of chunked pages."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda s: F.concat(F.lit("[PAG "), s.p.cast("string"), F.lit("]\n"), s.t)), "\n\n")
    g = pages.groupBy(key, "chunk").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("n"), joined.alias("text"))
    return g.withColumn("title", F.concat(F.lit("pag. "), F.col("first").cast("string"), F.lit("–"), F.col("last").cast("string")))


def drop_repeated_rows(rows: DataFrame, key: str, pos: str, cells: str) -> DataFrame:
    """Table rows equal to the row before go (merged cells leave such ghosts)."""
    before = F.lag(cells).over(Window.partitionBy(key).orderBy(pos))
    return rows.withColumn("_b", before).where(~F.col(cells).eqNullSafe(F.col("_b")) | F.col("_b").isNull()).drop("_b")


def block_text(blocks: DataFrame, key: str, gap: float = 10.0) -> DataFrame:
    """Page text of blocks (x0, y0, y1, text) from top to bottom, with an empty line where the vertical gap is over `gap`."""
    w = Window.partitionBy(key).orderBy("y0", "x0", "y1", "text")
    d = blocks.withColumn("_far", F.coalesce(F.col("y0") - F.lag("y1").over(w) > gap, F.lit(False))).withColumn("_n", F.row_number().over(w))
    piece = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_far", "text"))), lambda b: F.concat(F.when(b._far, F.lit("\n")).otherwise(F.lit("")), b.text))
    return d.groupBy(key).agg(F.array_join(piece, "\n").alias("text"))


def error_context(log: DataFrame, key: str, order: list[str], line: Column, most: int = 10) -> DataFrame:
    """Error lines with the two lines after them, the first `most` of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    d = log.withColumns({"_line": line, "after1": F.lead(line, 1).over(w), "after2": F.lead(line, 2).over(w)})
    return d.where(F.col("_line").startswith("!")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_line")


def latest(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The last `most` rows of each key, with rank 1 for the last."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)

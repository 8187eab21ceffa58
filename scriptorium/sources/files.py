"""Folders of files, uploads and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import strip_rtf
from scriptorium.operators.classify import kind_of

#: Names that a scan skips, limits, and first bytes by extension.
SKIP = (".ds_store", "thumbs.db", "desktop.ini", ".gitkeep", ".gitignore")
LARGEST = 3 << 30
MAGIC = (
    ("25504446", (".pdf",)), ("504B0304", (".pptx", ".docx", ".ppt", ".doc")), ("494433", (".mp3",)), ("FFFB", (".mp3",)), ("FFF3", (".mp3",)),
    ("FFF2", (".mp3",)), ("52494646", (".wav",)), ("4F676753", (".ogg", ".webm")), ("1A45DFA3", (".webm", ".mkv")), ("7B5C727466", (".rtf", ".txt")),
)
FTYP = (".mp4", ".m4a", ".m4v", ".mov")
HOSTS = r"teams\.microsoft\.com|sharepoint\.com|svc\.ms|microsoftstream\.com|api\.teams\.skype\.com"


def scan_folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """lesson (the folder's name), path, name, stem, ext, kind, content of the files that have a known kind.

    Content is read lazily: a query that does not use it only lists.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    d = d.withColumns({"name": name, "lesson": F.element_at(parts, -2)})
    d = d.withColumns({"ext": F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)), "stem": F.regexp_replace("name", r"\.[^.]+$", "")})
    return d.where(visible(F.col("name"))).withColumn("kind", kind_of(F.col("ext"))).where(F.col("kind").isNotNull())


def visible(name: Column) -> Column:
    return ~name.startswith(".") & ~name.startswith("__") & ~F.lower(name).isin(*SKIP)


def ordered(files: DataFrame) -> DataFrame:
    return files.orderBy("lesson", F.lower("name"))


def new_lessons(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has not been processed yet."""
    return found.join(done.select(key), key, "left_anti")


def texts(files: DataFrame) -> DataFrame:
    """Adds text to text files: UTF-8 with broken bytes dropped, RTF as plain text; blank files go."""
    raw = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    d = files.where("kind = 'text'").withColumn("text", strip_rtf(raw))
    return d.where(F.trim("text") != "")


def upload_problem(name: Column, size: Column) -> Column:
    """Why an upload is refused (null: it is not)."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(kind_of(ext).isNull(), "extension").when(size <= 0, "empty").when(size > LARGEST, "too large")


def batch_refused(problems: DataFrame, by: str, problem: str, urls: str) -> DataFrame:
    """A batch is refused only if nothing of it is saved and it has no addresses."""
    return problems.groupBy(by).agg(F.count_if(F.col(problem).isNull()).alias("saved"), F.max(urls).alias("n_urls")).withColumn("refused", (F.col("saved") == 0) & (F.col("n_urls") == 0))


def magic_problem(name: Column, head: Column) -> Column:
    """The extensions that a file's first bytes speak for, where its name has another; the first known prefix decides."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    out = F.when(F.hex(F.substring(head, 5, 4)) == "66747970", F.when(~ext.isin(*FTYP), F.lit(",".join(FTYP))))
    for prefix, exts in reversed(MAGIC):
        out = F.when(F.hex(head).startswith(prefix), F.when(~ext.isin(*exts), F.lit(",".join(exts)))).otherwise(out)
    return out


def cut_url(url: Column, parameter: str = "altTranscode=1") -> Column:
    """An address up to a parameter."""
    return F.regexp_replace(url, f"(?s)&{parameter}.*$", "")


def drop_parameter(url: Column, parameter: str = "altTranscode=1") -> Column:
    """An address without one parameter; the mark before it goes with it."""
    return F.regexp_replace(url, rf"[?&]{parameter}(?=&|$)", "")


def known_host(url: Column, hosts: str = HOSTS) -> Column:
    return url.rlike(f"(?i)^https?://[^/]*({hosts})")


def safe_path(name: Column) -> Column:
    return F.coalesce(~name.rlike(r"[/\\]|\.\.") & name.endswith(".tex"), F.lit(False))


def counters(text: Column) -> Column:
    """Counters as a map, from JSON or lines of name=value; others are 0."""
    lines = F.str_to_map(text, F.lit("\n"), F.lit("="))
    read = F.when(text.startswith("{"), F.from_json(text, "map<string,string>")).otherwise(lines)
    return F.transform_values(read, lambda k, v: F.coalesce(v.try_cast("int"), F.lit(0)))


def content_table(files: DataFrame) -> DataFrame:
    """Blobs by content: one row for each distinct digest."""
    return files.withColumn("md5", F.md5("content")).dropDuplicates(["md5"])

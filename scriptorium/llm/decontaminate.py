"""Benchmark decontamination by winnowing, in SQL functions only.

Both sides are cut into words, every GRAM words are hashed, and of each SPAN consecutive hashes the least is
kept with its place. Texts that share SPAN + GRAM - 1 = 10 words keep a common fingerprint there, so joining
fingerprints finds every shared window. Each hit is extended to the windows of ten words that it lies in, and
those are looked up among the items' windows by digests of their words. An item of fewer than ten words is a
window of its own length; its hash is joined with the hashes of that length.

Items stand once for each distinct window, and windows with equal lists of items share one list. So a passage that
many items and many documents share gives a row for each document and place, not for each document and item, and
items are gathered once for each distinct set of lists, not for each document.

Arrays are exploded with explode_outer: the inner form adds a filter on the array, which the optimizer pushes
below the steps that build it and so computes them again for every element.

Only documents with a hit are read again. Texts go by their digest, so copies are compared once and the size
of a group of copies does not matter. The benchmark's fingerprints, and the digests of documents with hits,
are broadcast only where their rows and bytes have been counted and are few; else these joins shuffle.

Defined results: a null text has no words and is clean; an item that is null or has no words has no windows;
repeated items with one id count once; repeated documents are decided alike; a text of any length is cut into
words whole and is one row; an empty benchmark leaves all documents clean, an empty table of documents gives no
rows; columns with any names pass through `drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import materialize

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: Word places take the low bits of a fingerprint, hashes the rest.
PLACE_BITS = 30
#: Rows and bytes that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 64 << 20
#: What lies between words, and the letters that are put in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _hashes(w: Column, n: int) -> Column:
    """Hash (high bits) and place (low bits) of each n consecutive words."""
    last = F.size(w) - n
    one = lambda i: F.bitwise_not(F.lit((1 << PLACE_BITS) - 1).cast("long")).bitwiseAND(F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)])).bitwiseOR(i.cast("long"))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _winnow(h: Column) -> Column:
    """The least of each SPAN consecutive hashes, each place once (ties: the first)."""
    last = F.size(h) - SPAN
    least = F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(h, i + k) for k in range(SPAN)]))
    return F.when(last >= 0, F.array_distinct(least)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _fingerprints(d: DataFrame, short: list[int]) -> DataFrame:
    """d has words; adds fps, an array of structs (k: length of gram, v: hash and place)."""
    d = d.withColumn("h", F.when(F.size("words") >= WINDOW, _hashes(F.col("words"), GRAM)).otherwise(F.expr("cast(array() as array<bigint>)")))
    d = d.withColumn("fps", _winnow(F.col("h"))).drop("h")
    for n in short:  # fewer than WINDOW lengths
        d = d.withColumn("fps", F.concat("fps", _hashes(F.col("words"), n)))
    return d


def _split(v: Column) -> tuple[Column, Column]:
    return F.shiftright(v, PLACE_BITS), v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int")


def small(df: DataFrame) -> bool:
    """Whether a table may be broadcast; no more is read than it takes to tell."""
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df) else df


def _window(w: Column, start: Column, n: Column) -> Column:
    """The digest of a window; words hold no spaces, so unlike windows have unlike texts."""
    return F.md5(F.array_join(F.slice(w, start + 1, n), " "))


def hits(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """digest, n_hit, n_items, items_sha256: for each text with contaminated words, how many, how many items are found there, and the digest of their sorted ids."""
    bench = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("iw")).where((F.size("iw") > 0) & F.col("item").isNotNull()).dropDuplicates()
    bench = materialize(bench, "benchmark")
    short = sorted(r["n"] for r in bench.select(F.size("iw").alias("n")).where(F.col("n") < WINDOW).distinct().collect())
    prints = bench.where(F.size("iw") >= WINDOW).select(F.explode_outer(_winnow(_hashes(F.col("iw"), GRAM))).alias("v"), F.lit(WINDOW).alias("n"))
    for n in short:
        prints = prints.unionByName(bench.where(F.size("iw") == n).select(F.explode_outer(_hashes(F.col("iw"), n)).alias("v"), F.lit(n).alias("n")))
    keys = materialize(prints.select(_split(F.col("v"))[0].alias("hash"), "n").distinct(), "fingerprints")
    n = F.least(F.lit(WINDOW), F.size("iw"))
    cut = F.transform(F.sequence(F.lit(0), F.size("iw") - n), lambda i: _window(F.col("iw"), i, n))
    windows = bench.select("item", F.explode_outer(cut).alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = materialize(windows.withColumn("list", F.md5(F.to_json("items"))), "windows")

    d = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), words(F.col("text")).alias("words"))
    v = _fingerprints(d, short).select("digest", F.explode_outer("fps").alias("v"))
    h, place = _split(F.col("v"))
    found = v.select("digest", h.alias("hash"), place.alias("at")).join(_sent(keys), "hash").select("digest", "n", "at").dropDuplicates()
    found = materialize(found, "hits")
    near = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    near = near.join(_sent(found.select("digest").distinct()), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    near = near.select("digest", words(F.col("text")).alias("words")).join(found.groupBy("digest").agg(F.collect_list(F.struct("n", "at")).alias("hits")), "digest")
    around = lambda x: F.transform(F.sequence(F.greatest(x.at - F.when(x.n == WINDOW, SPAN - 1).otherwise(0), F.lit(0)), x.at), lambda a: F.struct(x.n.alias("n"), a.alias("a")))
    tried = F.filter(F.array_distinct(F.flatten(F.transform("hits", around))), lambda x: x.a + x.n <= F.size("words"))
    tried = near.select("digest", F.explode_outer(F.transform(tried, lambda x: F.struct(x.n.alias("n"), x.a.alias("a"), _window(F.col("words"), x.a, x.n).alias("window")))).alias("x")).select("digest", "x.*")
    spans = tried.join(_sent(windows.select("window", "list")), "window").select("digest", "a", (F.col("a") + F.col("n")).alias("b"), "list")
    spans = materialize(spans, "spans")

    sets = materialize(spans.groupBy("digest").agg(F.sort_array(F.collect_set("list")).alias("lists")).withColumn("set", F.md5(F.array_join("lists", ","))), "sets")
    lists = windows.select("list", "items").dropDuplicates(["list"])
    each = sets.select("set", "lists").dropDuplicates(["set"]).select("set", F.explode_outer("lists").alias("list")).join(lists, "list")
    told = each.select("set", F.explode_outer("items").alias("item")).groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = told.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return _union_length(spans).join(sets.select("digest", "set"), "digest").join(told, "set").drop("set")


def _union_length(spans: DataFrame) -> DataFrame:
    """digest, n_hit: how many places the spans [a, b) of each text cover; each adds what reaches beyond those before it."""
    w = Window.partitionBy("digest").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("b") - F.greatest(F.col("a"), F.least(F.col("b"), F.coalesce(F.max("b").over(w), F.lit(0))))
    return spans.select("digest", "a", "b").distinct().withColumn("new", new).groupBy("digest").agg(F.sum("new").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = hits(docs, items).withColumnRenamed("digest", "_digest")
    d = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    j = d.join(_sent(materialize(found, "contaminated")), F.col("digest") == F.col("_digest"), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return j.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any contaminated word."""
    bad = materialize(hits(docs, items).select("digest"), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return rows.join(_sent(bad), "digest", "left_anti").select("row.*")

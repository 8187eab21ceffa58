"""Secret scans by a randomness test battery, in SQL functions only.

Base spans come from three patterns: assignments to secret-like names, access keys and long hexadecimal runs.
The method adds runs of encoded characters that look random. For each candidate run the encoding is inferred
from its characters, and its characters' places in that alphabet are tested for uniformity (the chi-squared
statistic, by way of its count of equal pairs, whose first three moments are exact at any length), for runs above
and below the middle of the alphabet, and for correlation of neighbours. The three depend on each other, so their
joint p-value is thrice the least of them, which holds under any dependence. A candidate is dropped where
randomness is rejected. Rejections are held to a false-discovery rate of `q` within each stratum of encoding and
length, because long runs give powerful tests and short ones weak tests: the Benjamini-Hochberg cut of a stratum
is read from a histogram of the logarithms of its p-values over the whole corpus, PER_DECADE cells to a power of
ten, down to 1e-DECADES. So it rejects nothing that the procedure on the p-values themselves would not, and all
that it would at a rate 4 % lower. What is collected is a bounded number of cells.

Candidates are runs of CANDIDATE characters with both letters and digits, and runs of LETTERS letters and more alone,
which have alphabets and strata of their own. Shorter runs of letters are words far more often than secrets, and the tests
do not tell these apart; neither they nor words with - or _ between them are candidates.

Positions are code points, ends exclusive. Matches of one pattern are found by splitting the text at them, so
a match's place is the sum of the lengths before it. A text is one row, whatever its length, and so are its matches.

Defined results: a null text is empty and has no spans; equal rows have equal results; an empty table gives no
rows; candidates that overlap a base span are not added again; other columns pass through `redact` whatever
their names, and n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, with the least length of what decides, and the candidate pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE, LETTERS = "[A-Za-z0-9+/_-]{20,}", "^[A-Za-z]{32,}$"
#: Alphabets, in the order of their digits' values.
ALPHABET = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base26": "abcdefghijklmnopqrstuvwxyz",
    "base52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
KINDS = ("assign", "access", "hex", "random")
#: Cells of the histogram of p-values to a power of ten, and powers of ten.
PER_DECADE, DECADES = 64, 18
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def located(text: Column, matches: Column, pattern: str, kind: str, value: Column | None = None) -> Column:
    """Spans of all matches of a pattern: matches has their texts, value another text to carry for each."""
    gaps = F.when(F.size(matches) > 0, F.split(text, pattern, -1))
    steps = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))), value if value is not None else matches, lambda s, v: F.struct(s.gap.alias("gap"), s.len.alias("len"), v.alias("value")))
    order = KINDS.index(kind)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("got"))

    def step(acc: Column, x: Column) -> Column:
        a = acc.at + x.gap
        span = F.struct(a.alias("start"), F.lit(order).alias("ord"), (a + x.len).alias("end"), F.lit(kind).alias("kind"), x.value.alias("value"))
        return F.struct((a + x.len).alias("at"), F.concat(acc.got, F.array(span)).alias("got"))

    return F.when(F.size(matches) > 0, F.aggregate(steps, start, step, lambda acc: acc.got)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: A published approximation of erfc, whose relative error is under 2e-7 everywhere (lowest power first).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def log_tail(z: Column) -> Column:
    """ln P(Z > z) of a normal distribution, for z of 0 and more (less: as 0)."""
    x = F.greatest(z, F.lit(0.0)) / 2**0.5

    def one(x: Column) -> Column:
        def two(t: Column) -> Column:
            poly = F.lit(ERFC[-1])
            for c in ERFC[-2::-1]:
                poly = poly * t + c
            return F.log(t) + poly - F.log(F.lit(2.0))

        return F.element_at(F.transform(F.array(1 / (1 + x / 2)), two), 1) - x * x

    return F.element_at(F.transform(F.array(x), one), 1)


def encoding(value: Column) -> Column:
    letters = F.when(value.rlike("^([a-z]+|[A-Z]+)$"), "base26").when(value.rlike("^[A-Za-z]+$"), "base52")
    return letters.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(value.rlike("^[A-Z2-7]+$"), "base32").when(value.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36").otherwise("base64")


def battery(value: Column) -> Column:
    """struct<enc, band, p, cell> of one candidate: its encoding, its band of length, the joint p-value of the three tests and its cell of the histogram.

    The steps are one-element arrays, each transformed into the next, so that no step is computed twice.
    """

    def then(array: Column, f) -> Column:
        return F.transform(array, f)

    def spelt(v: Column) -> Column:
        enc = encoding(v)
        plain = F.when(enc.isin("hex", "base36", "base26"), F.lower(v)).otherwise(F.translate(v, "-_", "+/"))
        alphabet = F.lit(None).cast("string")
        for name, letters in ALPHABET.items():
            alphabet = F.when(enc == name, letters).otherwise(alphabet)
        return F.struct(enc.alias("enc"), plain.alias("plain"), alphabet.alias("alphabet"))

    def digits(d: Column) -> Column:
        x = F.transform(F.split(d.plain, ""), lambda c: F.position(c, d.alphabet) - F.lit(1))
        return F.struct(d.enc.alias("enc"), F.length(d.alphabet).alias("a"), x.alias("x"))

    def means(d: Column) -> Column:
        n = F.size(d.x).cast("double")
        later = F.slice(d.x, 2, F.greatest(F.size(d.x) - 1, F.lit(1)))
        pairs = F.zip_with(F.slice(d.x, 1, F.size(d.x) - 1), later, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        return F.struct(d.enc.alias("enc"), d.a.alias("a"), d.x.alias("x"), n.alias("n"), (F.aggregate(d.x, F.lit(0.0), lambda acc, v: acc + v) / n).alias("mean"), pairs.alias("pairs"))

    def sums(d: Column) -> Column:
        squares = F.aggregate(F.array_distinct(d.x), F.lit(0.0), lambda acc, v: acc + F.pow(d.n - F.size(F.array_remove(d.x, v)), F.lit(2.0)))
        high = lambda v: v * 2 >= d.a
        turns = F.size(F.filter(d.pairs, lambda t: high(t.p) != high(t.q)))
        upper = F.size(F.filter(d.x, high)).cast("double")
        cross = F.aggregate(d.pairs, F.lit(0.0), lambda acc, t: acc + (t.p - d.mean) * (t.q - d.mean))
        spread = F.aggregate(d.x, F.lit(0.0), lambda acc, v: acc + (v - d.mean) * (v - d.mean))
        return F.struct(d.enc.alias("enc"), d.a.cast("double").alias("a"), d.n.alias("n"), squares.alias("sq"), (turns + 1).alias("runs"), upper.alias("up"), cross.alias("cross"), spread.alias("spread"))

    def scores(s: Column) -> Column:
        # Equal pairs: each has probability 1 / a, two of them are independent, and three only where they join three places.
        p, two = 1 / s.a, s.n * (s.n - 1) / 2
        var = two * p * (1 - p)
        skew = (var * (1 - 2 * p) + 2 * two * (s.n - 2) * p * p * (1 - p)) / F.pow(var, F.lit(1.5))
        y = ((s.sq - s.n) / 2 - F.lit(0.5) - two * p) / F.sqrt(var)
        ninth = skew * skew / 36  # of a gamma distribution with these moments: its cube root is nearly normal
        z_pairs = (F.pow(F.greatest(1 + skew * y / 2, F.lit(0.0)), F.lit(1 / 3)) - 1 + ninth) / F.sqrt(ninth)
        prod = 2 * s.up * (s.n - s.up)
        spread = prod * (prod - s.n) / (s.n * s.n * (s.n - 1))
        z_runs = F.when(spread > 0, (F.abs(s.runs - prod / s.n - 1) - F.lit(0.5)) / F.sqrt(F.greatest(spread, F.lit(1e-9))))
        moran = (s.n - 2) / (s.n * F.sqrt(s.n - 1))
        z_serial = F.when(s.spread > 0, F.abs(s.cross / F.greatest(s.spread, F.lit(1e-9)) + 1 / s.n) / moran)
        return F.struct(s.enc.alias("enc"), s.n.alias("n"), s.a.alias("a"), z_pairs.alias("pairs"), z_runs.alias("runs"), z_serial.alias("serial"))

    def values(s: Column) -> Column:
        two_sided = lambda z: F.log(F.lit(2.0)) + log_tail(z)
        one_side = (1 - s.n) * F.log(F.lit(2.0))  # all characters in one half of the alphabet
        one_letter = (1 - s.n) * F.log(s.a)
        least = F.least(log_tail(s.pairs), F.coalesce(two_sided(s.runs), one_side), F.coalesce(two_sided(s.serial), one_letter))
        p = F.least(least + F.log(F.lit(3.0)), F.lit(0.0))
        cell = F.least(F.floor(-p / F.log(F.lit(10.0)) * PER_DECADE), F.lit(PER_DECADE * DECADES)).cast("int")
        band = F.when(s.n < 32, 20).when(s.n < 64, 32).when(s.n < 128, 64).otherwise(128)
        return F.struct(s.enc.alias("enc"), band.alias("band"), F.exp(p).alias("p"), cell.alias("cell"))

    return F.element_at(then(then(then(then(then(then(F.array(value), spelt), digits), means), sums), scores), values), 1)


def candidate(run: Column) -> Column:
    return run.rlike(LETTERS) | run.rlike("[0-9]") & run.rlike("[A-Za-z]")


def candidates(text: Column) -> Column:
    """Texts of the candidate runs."""
    return F.filter(extract(text, CANDIDATE), candidate)


def cuts(docs: DataFrame, q: float = 0.05) -> dict[tuple[str, int], int]:
    """For each stratum the cell from which on randomness is rejected, over all candidates of the corpus (none: no cut)."""
    tested = docs.select(F.explode_outer(candidates(F.coalesce("text", F.lit("")))).alias("v")).where(F.col("v").isNotNull()).select(battery(F.col("v")).alias("t"))
    cells = tested.groupBy("t.enc", "t.band", "t.cell").agg(F.count("*").alias("n"))
    rows: dict[tuple[str, int], list] = {}
    for r in cells.collect():  # at most PER_DECADE * DECADES + 1 cells for each of 24 strata
        rows.setdefault((r["enc"], r["band"]), []).append((r["cell"], r["n"]))
    return {stratum: cut for stratum, found in rows.items() if (cut := cut_of(found, q)) is not None}


def cut_of(cells: list[tuple[int, int]], q: float) -> int | None:
    """Benjamini-Hochberg on a histogram (cell, count), each p-value taken as the largest of its cell: the first rejected cell."""
    total, seen, cut = sum(n for _, n in cells), 0, None
    for cell, n in sorted(cells, reverse=True):
        seen += n
        if 10 ** (-cell / PER_DECADE) <= q * seen / total:
            cut = cell
    return cut


def find_spans(docs: DataFrame, cut: dict[tuple[str, int], int]) -> DataFrame:
    """Adds `base` and `added`: arrays of spans, each in ascending order."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.drop("base", "added", "_a", "_b", "_h", "_r", "_v").withColumns({"_a": extract(t, ASSIGN), "_b": extract(t, ACCESS), "_h": extract(t, HEX), "_r": extract(t, CANDIDATE)})
    secret = F.when(F.size("_a") > 0, extract(t, ASSIGN, 2)).otherwise(F.expr("cast(array() as array<string>)"))
    d = d.withColumn("_v", secret)
    assign = F.filter(located(t, F.col("_a"), ASSIGN, "assign", F.col("_v")), lambda s: F.length(s.value) >= ASSIGN_LEAST)
    base = F.sort_array(F.concat(assign, located(t, F.col("_b"), ACCESS, "access"), located(t, F.col("_h"), HEX, "hex")))
    some = F.exists(F.col("_r"), candidate)
    runs = F.when(some, F.filter(located(t, F.col("_r"), CANDIDATE, "random"), lambda s: candidate(s.value))).otherwise(F.expr(f"cast(array() as {SPAN})"))
    d = d.withColumns({"base": base, "_c": runs})

    def kept(r: Column) -> Column:
        first = F.lit(PER_DECADE * DECADES + 1)
        for (enc, band), cell in cut.items():
            first = F.when((r.enc == enc) & (r.band == band), cell).otherwise(first)
        return r.cell < first

    def random(s: Column) -> Column:
        return F.element_at(F.transform(F.array(battery(s.value)), kept), 1)  # told once, not for each stratum

    apart = F.filter("_c", lambda s: ~F.exists("base", lambda b: (b.start < s.end) & (s.start < b.end)))
    d = d.withColumn("_c", apart)
    return d.withColumn("added", F.when(F.size("_c") > 0, F.filter("_c", random)).otherwise(F.col("_c"))).drop("_a", "_b", "_h", "_r", "_v", "_c")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of the base spans, and all spans."""
    found = find_spans(docs.select("doc_id", "text"), cuts(docs, q))
    number = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"))


def redact(docs: DataFrame, q: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """Texts with each span, or run of overlapping spans, replaced by a mark; texts without spans stay as they are."""
    d = find_spans(docs.select(F.struct(*docs.columns).alias("row"), "text"), cuts(docs, q))
    spans = F.sort_array(F.concat("base", "added"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        parts = F.when(s.start >= acc.at, F.concat(acc.parts, F.array(F.substring(F.col("text"), acc.at + 1, s.start - acc.at), F.lit(mark)))).otherwise(acc.parts)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), parts.alias("parts"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc.parts, ""), F.substring(F.col("text"), acc.at + 1, F.length("text"))))
    text = F.when(F.size(F.concat("base", "added")) > 0, whole).otherwise(F.col("text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return d.select(row.alias("row")).select("row.*")

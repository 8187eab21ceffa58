"""Fill-in-middle transformation by an escaped marker, in string functions only.

A text is cut into units (a word with the white space before it; white space at the end is a unit of its own)
without an array of them: a delimiter that stands in the text is escaped, regexp_replace writes the delimiter
after each unit, and what the text has grown by is the number of units. substring_index then cuts the text behind
the units of any two ranks; the delimiters go, the escapes are undone, and prefix, middle and suffix are put
together with markers: suffix first (spm), prefix first (psm), or the text as it is (plain).

The places of the cuts and the form come from a hash of seed and doc_id alone, so a document is transformed
alike in every run and order. `restored` rebuilds the text from output and form.

One projection over the scan: nothing is shuffled, and each step takes time in proportion to the text.

Defined results: a null text is empty; an empty text, and one that holds a marker, stays plain; a null doc_id
is hashed as no digits; repeated rows get equal results; a very long text is one string, as Spark itself holds it;
an empty table gives no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a unit while ranks are counted, what escapes it, and what stands for either of them in an escaped text.
DELIMITER, ESCAPE = "\x1f", "\x1e"
OF_ESCAPE, OF_DELIMITER = ESCAPE + "0", ESCAPE + "1"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Markers:
    """What stands before each part; no marker may be within another, nor end as one begins."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def escaped(text: Column) -> Column:
    """A text without the delimiter; neither sign nor its stand-in is white space, so units stay units."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(OF_ESCAPE)), F.lit(DELIMITER), F.lit(OF_DELIMITER))


def unescaped(part: Column) -> Column:
    """The text of a part of marked units."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(OF_DELIMITER), F.lit(DELIMITER)), F.lit(OF_ESCAPE), F.lit(ESCAPE))


def parts(marked: Column, n: Column, first: Column, second: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix: the units up to rank `first`, from there up to `second`, and the rest."""
    index = lambda text, count: F.call_function("substring_index", text, F.lit(DELIMITER), count)
    before = index(marked, second)
    return unescaped(index(marked, first)), unescaped(index(before, first - second)), unescaped(index(marked, second - n - 1))


def draw(digest: Column, k: int) -> Column:
    """The k-th group (from 0) of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def infilled(docs: DataFrame, rate: int = 50, suffix_first: int = 80, seed: int = 42, markers: Markers = Markers()) -> DataFrame:
    """doc_id, n, form, prefix, middle, suffix, output: parts are null where the form is plain.

    rate: how many of a hundred documents are transformed; suffix_first: how many of a hundred of those are spm.
    """
    p, s, m = markers.all()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("_digest"))
    rows = rows.withColumn("_escaped", escaped(F.col("text")))
    rows = rows.withColumn("_marked", F.regexp_replace("_escaped", UNIT, f"$0{DELIMITER}"))
    rows = rows.withColumn("n", (F.length("_marked") - F.length("_escaped")).cast("long"))
    cut = [draw(F.col("_digest"), k) % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.withColumn("_first", F.least(*cut).cast("int")).withColumn("_second", F.greatest(*cut).cast("int"))
    held = F.lit(False)
    for marker in markers.all():
        held = held | F.contains("text", F.lit(marker))
    form = F.when((F.col("text") == "") | held | (draw(F.col("_digest"), 2) % 100 >= rate), PLAIN)
    rows = rows.withColumn("form", form.when(draw(F.col("_digest"), 3) % 100 < suffix_first, SPM).otherwise(PSM))
    split = F.col("form") != PLAIN
    three = parts(F.col("_marked"), F.col("n").cast("int"), F.col("_first"), F.col("_second"))
    rows = rows.withColumns({k: F.when(split, v) for k, v in zip(("prefix", "middle", "suffix"), three, strict=True)})
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    output = F.when(F.col("form") == PLAIN, F.col("text")).when(F.col("form") == SPM, spm).otherwise(psm)
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text of an output, from output and form alone: markers stand in no part, so each is found at its place."""
    p, s, m = markers.all()
    ahead, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(ahead, s, 1), p, -1), middle, F.substring_index(ahead, s, -1))
    spm = F.concat(F.substring_index(ahead, p, -1), middle, F.substring_index(F.substring_index(ahead, p, 1), s, -1))
    return F.when(form == PLAIN, output).when(form == SPM, spm).otherwise(psm)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    rows = infilled(docs)
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )

"""Text helpers with the whitespace and line rules of the semantics that are reproduced here.

Java's \\s, \\w and case folding cover ASCII only unless (?U) is set, and its ^ and $ break at more than \\n unless
(?d) is set; SQL's trim strips spaces alone. These helpers settle that once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of Unicode, as (?U)\\s has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use) -> Column:
    """use(value), with value told once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def told(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is told once for each row, however many filters and columns above name it.

    The optimizer puts a column's expression in place of its name, in each filter and function that it stands in; it does not
    do so with what a generator gives.
    """
    return rows.select(*[c for c in rows.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def visible(text: Column) -> Column:
    """How many characters are no white space."""
    return F.length(F.translate(text, SPACES, ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def lines(text: Column) -> Column:
    """Split at \\n alone."""
    return F.split(text, "\n")


def text_lines(text: Column) -> Column:
    """Split at every line end; a last empty line does not count."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return once(parts, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


def empty(kind: str = "string") -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def title_case(text: Column) -> Column:
    """Every run of letters with a first capital, whatever stands between runs."""
    parts = F.regexp_extract_all(text, F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def name_title(stem: Column) -> Column:
    """A title from a file or folder name."""
    return title_case(F.translate(stem, "_-", "  "))


def safe_name(name: Column, default: str = "output") -> Column:
    kept = F.regexp_replace(name, r"(?U)[^\p{L}\p{N}_\-. /]", "")
    return F.coalesce(F.nullif(F.replace(F.regexp_replace(kept, r"^[./]+|[./]+\z", ""), F.lit("/"), F.lit("_")), F.lit("")), F.lit(default))

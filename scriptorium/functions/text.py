"""Cleaning, measuring and cutting of texts as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.pyre import SPACES, empty, lines, once, rstrip, strip, text_lines, visible

#: What cleaning removes, in order.
REMOVE = (
    r"(?iU)\bpag(?:ina|\.?)?\s*\d+\b",
    r"(?mdU)^\s*\d+\s*$",
    r"(?mdU)^\s*[-–—]+\s*$",
    r"(?U)\[\d{2}:\d{2}\]\s*",
    r"(?id)©.*?(?:\n|$)",
    r"(?iU)slide\s+\d+\s*/\s*\d+",
    r"(?idU)department\s+of\s+\w+.*?\n",
    r"(?idU)university\s+of\s+\w+.*?\n",
    r"(?idU)a\.y\.\s*\d{4}[-/]\d{2,4}.*?\n",
)
#: Phrases that make a line a filler.
FILLER = (
    r"\bcome\s+(?:già\s+)?(?:detto|visto|accennato)\b",
    r"\bcome\s+(?:vedremo|abbiamo\s+visto)\b",
    r"\bin\s+altre\s+parole\b",
    r"\bè\s+importante\s+(?:notare|sottolineare)\b",
    r"\bcioè\s+a\s+dire\b",
    r"\blet(?:'s| us)\s+(?:now\s+)?(?:look at|consider|see)\b",
    r"\bin\s+this\s+(?:slide|lecture)\s+we\b",
    r"\bso,?\s+(?:basically|essentially|fundamentally)\b",
)
#: Limits.
JOIN_BELOW, DENSE_OVER, OUTLINE_OVER, CUT_SHARE = 80, 80_000, 180_000, 0.85
BUDGET = {"CARNE": 200_000, "SCHELETRO": 160_000, "SUPPORTO": 80_000, "CONTORNO": 40_000}
SPARSE = 80
FOOTER = r"^\s*(?:[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}|https?://\S+|\d{1,4}\s*/\s*\d{1,4})\s*$"
COMMAND = r"\\[a-zA-Z]+"
#: The characters that Windows-1252 has where Latin-1 has controls.
LATIN_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS_LETTERS = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def remove_noise(text: Column) -> Column:
    for p in REMOVE:
        text = F.regexp_replace(text, p, "")
    return text


#: A line end that nothing joins over: the next line does not begin in lower case.
HARD_END = r"\n(?!\p{javaLowerCase})"


def rejoin(text: Column) -> Column:
    """Lines broken within a sentence are joined: one that begins in lower case goes to the line before, as that has grown, while it is short and does not end a clause.

    Whether a line is joined depends on what its own run of lower-case lines has grown to, so runs are folded each by itself.
    """
    start = F.struct(empty().alias("out"), F.lit(None).cast("string").alias("last"))

    def step(acc: Column, raw: Column) -> Column:
        line = rstrip(raw)
        join = line.rlike(r"^\p{javaLowerCase}") & acc.last.isNotNull() & (acc.last != "") & ~acc.last.rlike(r"""[.!?:;)\]"]\z""") & (F.length(acc.last) < JOIN_BELOW)
        join = F.coalesce(join, F.lit(False))
        out = F.when(join | acc.last.isNull(), acc.out).otherwise(F.concat(acc.out, F.array(acc.last)))
        return F.struct(out.alias("out"), F.when(join, F.concat_ws(" ", acc.last, line)).otherwise(line).alias("last"))

    folded = lambda run: F.aggregate(lines(run), start, step, lambda acc: F.array_join(F.concat(acc.out, F.array(acc.last)), "\n"))
    return F.array_join(F.transform(F.split(text, HARD_END), lambda run: F.when(F.contains(run, F.lit("\n")), folded(run)).otherwise(rstrip(run))), "\n")


def squeeze_blank(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def clean(text: Column) -> Column:
    """Noise out, broken lines joined, blank runs squeezed (null: empty)."""
    return strip(squeeze_blank(rejoin(remove_noise(F.coalesce(text, F.lit(""))))))


def repair_doubled(text: Column) -> Column:
    """Characters all written twice, by some fonts, become single where pairs are over 0.4 of what is visible.

    So many pairs stand side by side somewhere; a text without two such pairs is not counted.
    """
    seen = F.translate(text, SPACES, "")
    pair, two = r"(?d)(.)\1", r"(?d)(.)\1(.)\2"
    counted = once(seen, lambda x: x.rlike(two) & ((F.length(x) - F.length(F.regexp_replace(x, pair, "$1"))) / F.length(x) > 0.40))  # each pair shrinks by one
    return F.when(F.coalesce(counted, F.lit(False)), F.regexp_replace(text, pair, "$1")).otherwise(text)


def clean_extracted(text: Column) -> Column:
    """Text of a page: doubled characters, padding lines, runs of spaces and of blank lines."""
    def padding(line: Column) -> Column:
        return (F.length(strip(line)) < 5) & ((F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))) / F.length(line) > 0.85)

    kept = F.filter(text_lines(repair_doubled(text)), lambda x: (x == "") | ~padding(x))
    tidy = F.transform(kept, lambda x: rstrip(F.regexp_replace(x, "  +", " ")))
    return F.when(text == "", text).otherwise(strip(squeeze_blank(F.array_join(tidy, "\n"))))


def token_estimate(text: Column) -> Column:
    plain = F.floor(F.length(F.regexp_replace(text, COMMAND, " ")) / 3).cast("int")
    return F.greatest(F.lit(1), plain) + F.size(F.regexp_extract_all(text, F.lit(COMMAND), F.lit(0)))


def prompt_tokens(system: Column, user: Column) -> Column:
    return F.floor((F.length(system) + F.length(user)) / 4).cast("int")


def compression_mode(tokens: Column, forced: Column | None = None, dense: int = DENSE_OVER, outline: int = OUTLINE_OVER) -> Column:
    mode = F.when(tokens > outline, "OUTLINE").when(tokens > dense, "DENSE").otherwise("RAW_CLEAN")
    return mode if forced is None else F.coalesce(forced, mode)


def density(text: Column) -> Column:
    """Share of visible characters (empty: 0)."""
    return F.when(F.length(text) > 0, visible(text) / F.length(text)).otherwise(F.lit(0.0))


def drop_fillers(text: Column, patterns: tuple[str, ...] = FILLER) -> Column:
    bad = "(?iU)" + "|".join(patterns)
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(bad)), "\n")


def drop_footers(text: Column) -> Column:
    return strip(F.array_join(F.filter(text_lines(text), lambda x: ~x.rlike(FOOTER)), "\n"))


def truncate(text: Column, limit: Column) -> Column:
    """At most `limit` characters, cut at a line end in the last 15 %, with a note of what is left out."""
    cut = F.substring(text, F.lit(1), limit)
    back = F.locate("\n", F.reverse(cut))
    at = F.when(back > 0, F.length(cut) - back).otherwise(F.lit(-1))
    cut = F.when(at > limit * CUT_SHARE, F.substring(cut, F.lit(1), at)).otherwise(cut)
    note = F.concat(F.lit("\n\n[... "), F.format_number(F.length(text) - F.length(cut), 0), F.lit(" caratteri omessi per rispettare il budget token ...]"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, note))


def role_budget(role: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in BUDGET.items():
        out = F.when(role == name, n).otherwise(out)
    return out


def clean_answer(text: Column, compat: bool = False) -> Column:
    """A model's answer without code fences, what stands before the first command and what follows the last closing.

    compat: what follows the *first* line that ends in \\end{} or } goes, as the original rule has it.
    """
    # must-match patterns of fences, of a chapter's first command and of its closing
    t = strip(F.regexp_replace(F.regexp_replace(text, r"(?mdU)^```(?:latex)?\s*\n", ""), r"(?mdU)\n```\s*$", ""))
    first = F.regexp_instr(t, F.lit(r"\\(?:section|chapter|subsection|begin)\s*[\[{]"))
    t = F.when(first > 1, F.substring(t, first, F.length(t))).otherwise(t)
    close = r"(?:\\end\{[^}]+\}|(?<=^|\n)\})(?=\s*(?:\n|\z))"
    greedy = f"(?s)^.*?{close}" if compat else f"(?s)^.*{close}"
    kept = F.regexp_extract(t, greedy, 0)
    return strip(F.when(kept != "", kept).otherwise(t))


def truncate_context(text: Column, limit: int = 6000) -> Column:
    """The beginning of the chapter before, as context of the next one."""
    t = strip(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("\n% ... [troncato per brevità] ..."))).otherwise(t)


#: What RTF's control words become, in order.
RTF = ((r"\\\n", "\n"), (r"\\par\b", "\n"), (r"\\line\b", "\n"), (r"\\\\\s?", ""), (r"\\[a-z]+\-?\d*\s?", ""), (r"\{[^{}]{0,200}\}", ""), (r"[{}]", ""))
#: What may stand around a formula, in order.
WRAPPERS = (
    (r"^\$\$?\s*", ""), (r"\s*\$\$?$", ""), (r"^\\\\\(\s*", ""), (r"\s*\\\\\)$", ""), (r"^\\\\\[\s*", ""), (r"\s*\\\\\]$", ""),
    (r"\\begin\{equation\*?\}", ""), (r"\\end\{equation\*?\}", ""), (r"[ \t]+", " "), ("\n{2,}", "\n"),
)


def replaced(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Patterns replaced one after the other."""
    for pattern, to in table:
        text = F.regexp_replace(text, pattern, to)
    return text


def strip_rtf(raw: Column) -> Column:
    """Plain text of an RTF file, control words first; other texts pass."""
    t = replaced(raw, RTF)
    coded = F.split(t, r"\\'(?=[0-9a-f]{2})")
    decoded = F.transform(coded, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.translate(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), LATIN_CONTROLS, WINDOWS_LETTERS), F.substring(p, 3, 1 << 30))))
    return F.when(raw.rlike(r"(?U)^\s*\{\\rtf"), strip(squeeze_blank(F.array_join(decoded, "")))).otherwise(raw)


def wrap(text: Column, width: int) -> Column:
    """Lines of greedily filled words, by characters."""
    start = F.struct(empty().alias("out"), F.lit("").alias("last"))

    def step(acc: Column, word: Column) -> Column:
        fits = F.length(acc.last) + 1 + F.length(word) <= width
        return F.when(acc.last == "", F.struct(acc.out.alias("out"), word.alias("last"))).when(fits, F.struct(acc.out.alias("out"), F.concat_ws(" ", acc.last, word).alias("last"))).otherwise(F.struct(F.concat(acc.out, F.array(acc.last)).alias("out"), word.alias("last")))

    return F.aggregate(F.array_remove(F.split(text, r"(?U)\s+"), ""), start, step, lambda a: F.when(a.last != "", F.concat(a.out, F.array(a.last))).otherwise(a.out))


#: Corrections of recognised formulas, and names that become commands.
OCR_FIX = ((r"\b[|I]([0-9])\b", "1$1"), (r"\b(?<one>[0-9])[|I]\b", "${one}1"), (r"(?<![a-zA-Z])O(?![a-zA-Z])", "0"), (r"\bI\b", "1"), ("—", "-"), ("–", "-"), ("’", "'"), ("[“”]", '"'))
OCR_NAMES = (
    "alpha", "beta", "gamma", "delta", "epsilon", "lambda", "mu", "sigma", "omega", "pi", "theta", "phi", "infty", "sum", "int", "sqrt", "frac",
    "cdot", "times", "div", "pm", "leq", "geq", "neq", "approx", "forall", "exists", "partial", "nabla", "in", "subset", "cup", "cap", "lim",
    "max", "min", "sin", "cos", "tan", "log", "ln", "exp",
)


def fix_ocr(raw: Column) -> Column:
    """A recognised formula as LaTeX (null if fewer than two characters are left)."""
    t = replaced(strip(raw), OCR_FIX)
    t = F.regexp_replace(t, rf"(?<![a-zA-Z])({'|'.join(OCR_NAMES)})(?![a-zA-Z])", r"\\$1")
    t = F.regexp_replace(t, r"(?U)\s*([+\-*/=^_<>])\s*", "$1")
    t = F.regexp_replace(t, r"(?U)\s*([{}])\s*", "$1")
    t = strip(F.regexp_replace(t, "\n+", " "))
    return F.when(F.length(F.regexp_replace(t, r"(?U)\s+", "")) >= 2, bare_latex(t))


def bare_latex(latex: Column) -> Column:
    """Without the wrappers of a formula."""
    return strip(replaced(latex, WRAPPERS))


def plausible_latex(latex: Column) -> Column:
    t = strip(latex)
    junk = t.rlike(r"^[.\s,;:]+$") | t.rlike(r"^[a-zA-Z]{1,2}$") | t.rlike(r"(?U)^\d+$") | t.rlike(r"[^\x00-\x7F]{5,}")
    return F.coalesce((F.length(t) >= 2) & ~junk & t.rlike(r"[\\{}^_+=\-/*<>\p{L}\p{N}]"), F.lit(False))

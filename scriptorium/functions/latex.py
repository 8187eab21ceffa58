"""Characters and text blocks in LaTeX."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.pyre import strip

#: Special characters of LaTeX.
SPECIAL = {
    "\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "^": r"\^{}", "_": r"\_",
    "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "<": r"\textless{}", ">": r"\textgreater{}",
}
#: Commands of mathematical symbols.
SYMBOL = {
    "→": "rightarrow", "←": "leftarrow", "↑": "uparrow", "↓": "downarrow", "⇒": "Rightarrow", "⇐": "Leftarrow",
    "≈": "approx", "≠": "neq", "≤": "leq", "≥": "geq", "±": "pm", "∓": "mp", "×": "times", "÷": "div", "∞": "infty",
    "∈": "in", "∉": "notin", "∩": "cap", "∪": "cup", "∑": "sum", "∏": "prod", "∫": "int", "∂": "partial",
    "∝": "propto", "≡": "equiv", "≪": "ll", "≫": "gg", "⊂": "subset", "⊃": "supset", "⊆": "subseteq", "⊇": "supseteq",
    "⊕": "oplus", "⊗": "otimes", "∧": "wedge", "∨": "vee", "¬": "neg", "∀": "forall", "∃": "exists", "∇": "nabla", "·": "cdot",
}
#: Commands of Greek letters.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "varepsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "φ": "varphi",
    "χ": "chi", "ψ": "psi", "ω": "omega", "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Π": "Pi",
    "Σ": "Sigma", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega",
}
#: What text mode has besides.
TEXT_ONLY = {
    "∅": r"$\emptyset$", "√": r"$\sqrt{}$", "−": "$-$", "∗": r"$\ast$", "△": r"$\triangle$", "°": r"\textdegree{}",
    "–": "--", "—": "---", "\u00a0": "~", "…": r"\ldots{}", "©": r"\textcopyright{}", "®": r"\textregistered{}",
    "™": r"\texttrademark{}", "€": r"\texteuro{}", "£": r"\pounds{}",
}
#: babel's names of language codes.
BABEL = {
    "it": "italian", "en": "english", "fr": "french", "de": "ngerman", "es": "spanish", "pt": "portuguese", "nl": "dutch",
    "ru": "russian", "pl": "polish", "cs": "czech", "el": "greek", "zh": "chinese", "ja": "japanese", "ar": "arabic",
}
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def letters() -> dict[str, tuple[str, bool]]:
    """Mathematical italic and bold italic letters: plain letter, and whether it is bold."""
    out = {}
    for base, bold in ((0x1D434, False), (0x1D468, True)):
        for i, plain in enumerate(string.ascii_uppercase + string.ascii_lowercase):
            out["ℎ" if (plain, bold) == ("h", False) else chr(base + i)] = (plain, bold)
    return out


def text_map() -> dict[str, str]:
    """Unicode to LaTeX in text mode."""
    out = {chr(0x2080 + d): f"$_{{{d}}}$" for d in range(10)} | {c: f"$^{{{d}}}$" for d, c in enumerate(SUPERSCRIPTS)}
    out |= {c: f"$\\{name}$" for c, name in (SYMBOL | GREEK).items()} | TEXT_ONLY
    return out | {c: rf"$\boldsymbol{{{plain}}}$" if bold else f"${plain}$" for c, (plain, bold) in letters().items()}


def formula_map() -> dict[str, str]:
    """Unicode to LaTeX in math mode."""
    out = {chr(0x2080 + d): f"_{d}" for d in range(10)} | {c: f"^{d}" for d, c in enumerate(SUPERSCRIPTS)}
    out |= {c: f"\\{name} " for c, name in (SYMBOL | GREEK).items()} | {"−": "-", "√": r"\sqrt"}
    return out | {c: rf"\boldsymbol{{{plain}}}" if bold else plain for c, (plain, bold) in letters().items()}


def ranges(table: dict[str, str], gap: int = 8) -> str:
    """The inside of a character class that holds a table's keys, as few ranges: beyond ASCII, neighbours may be in it too."""
    out = "".join("\\" + c if c in "\\^[]&-" else c for c in table if c < "\x80")
    far = sorted(ord(c) for c in table if c >= "\x80")
    if not far:
        return out
    start = last = far[0]
    for c in [*far[1:], None]:
        if c is None or c - last > gap:
            out += rf"\x{{{start:X}}}-\x{{{last:X}}}"
            start = c
        last = c
    return out


def _mapped(text: Column, table: dict[str, str]) -> Column:
    """Each character through a table at once, so no replacement is replaced again; texts without such characters pass.

    A text is cut into characters of the table and the runs between them, so what lies between is looked up once.
    """
    inner = ranges(table)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    one = lambda c: F.when(F.length(c) == 1, F.coalesce(F.element_at(pairs, c), c)).otherwise(c)
    runs = F.regexp_extract_all(text, F.lit(f"[{inner}]|[^{inner}]+"), F.lit(0))
    return F.when(text.rlike(f"[{inner}]"), F.array_join(F.transform(runs, one), "")).otherwise(text)


def escape(text: Column) -> Column:
    return _mapped(text, SPECIAL | text_map())


#: The characters of narrower escapes: one pass over a text, titles, chapter texts and table cells.
PLAIN, TITLE_CHAIN, TEXT_CHAIN, CELL_CHAIN = "\\&%$#_^{}~", "\\&%$#_^{}~", "\\&%$#{}", "&%$#_{}"


def escape_once(text: Column) -> Column:
    """The escape of a reduced installation: ten characters, each once."""
    return _mapped(text, {c: SPECIAL[c] for c in PLAIN})


def escape_chained(text: Column, characters: str = TITLE_CHAIN, tilde: str = r"\~{}") -> Column:
    """One character after the other, so that braces that one replacement adds are escaped by a later one, as observed."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(tilde if c == "~" else SPECIAL[c]))
    return text


def sanitize_formula(text: Column) -> Column:
    return _mapped(text, formula_map())


def babel_name(lang: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in BABEL.items() for x in kv])
    return F.when(F.length(lang) <= 3, F.coalesce(F.element_at(named, lang), lang)).otherwise(lang)


HEADER = r"""\documentclass[12pt,a4paper]{article}
\usepackage[utf8]{inputenc}
\usepackage[T1]{fontenc}
\usepackage{textcomp}
\usepackage[BABEL]{babel}
\usepackage{amsmath,amssymb,amsfonts}
\usepackage{graphicx,float,geometry,hyperref,xcolor,booktabs,enumitem,fancyhdr}
\geometry{margin=2.5cm}
\pagestyle{fancy}
\graphicspath{{./images/}}
\begin{document}
"""


def header(lang: Column) -> Column:
    return F.replace(F.lit(HEADER), F.lit("BABEL"), babel_name(lang))


def text_block(text: Column) -> Column:
    """Paragraphs and bullet lists: lines that begin with a bullet become items of one list until another line ends it."""
    lines = F.transform(F.split(strip(text), "\n"), strip)
    bullet = "^[•\\-*–]"
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(False).alias("open"))

    def step(acc: Column, line: Column) -> Column:
        item = line.rlike(bullet)
        body = F.concat(F.lit(r"  \item "), escape(strip(F.regexp_replace(line, "^[•\\-*– ]+", ""))))
        add = F.when(line == "", F.when(acc.open, F.array(F.lit(r"\end{itemize}"), F.lit(""))).otherwise(F.array(F.lit(""))))
        add = add.when(item, F.when(acc.open, F.array(body)).otherwise(F.array(F.lit(r"\begin{itemize}"), body)))
        add = add.otherwise(F.when(acc.open, F.array(F.lit(r"\end{itemize}"), F.lit(""), escape(line))).otherwise(F.array(escape(line))))
        return F.struct(F.concat(acc.out, add).alias("out"), ((line != "") & item).alias("open"))

    return F.aggregate(lines, start, step, lambda a: F.array_join(F.when(a.open, F.concat(a.out, F.array(F.lit(r"\end{itemize}")))).otherwise(a.out), "\n"))


def tabular(rows: Column) -> Column:
    """A table (array of rows of cells); short rows are filled up, with lines after the first and the last row."""
    width = F.array_max(F.transform(rows, F.size))
    row = lambda r: F.concat(F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: escape(F.coalesce(c, F.lit("")))), " & "), F.lit(" \\\\"))
    lined = lambda r, i: F.when((i == 0) | (i == F.size(rows) - 1), F.concat(row(r), F.lit("\n\\hline"))).otherwise(row(r))
    spec = F.array_join(F.array_repeat(F.lit("l"), width), "|")
    return F.when(F.size(rows) > 0, F.concat(F.lit("\\begin{tabular}{|"), spec, F.lit("|}\n\\hline\n"), F.array_join(F.transform(rows, lined), "\n"), F.lit("\n\\end{tabular}")))


def figure(name: Column, caption: Column) -> Column:
    return F.concat(F.lit("\\begin{figure}[H]\n  \\centering\n  \\includegraphics[width=\\textwidth]{"), name, F.lit("}\n  \\caption{"), escape(caption), F.lit("}\n\\end{figure}\n"))

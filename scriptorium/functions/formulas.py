"""Office Math XML to LaTeX.

Formulas are trees, which SQL types cannot hold, so this is an Arrow UDF over distinct strings; see
`convert` for the join back. Each element kind has a template: its parts are converted first and filled in.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATH = "http://schemas.openxmlformats.org/officeDocument/2006/math"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Symbols inside formulas.
SYMBOL = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "ζ": r"\zeta", "η": r"\eta", "θ": r"\theta",
    "ι": r"\iota", "κ": r"\kappa", "λ": r"\lambda", "μ": r"\mu", "ν": r"\nu", "ξ": r"\xi", "π": r"\pi", "ρ": r"\rho",
    "σ": r"\sigma", "τ": r"\tau", "υ": r"\upsilon", "φ": r"\phi", "χ": r"\chi", "ψ": r"\psi", "ω": r"\omega",
    "Γ": r"\Gamma", "Δ": r"\Delta", "Θ": r"\Theta", "Λ": r"\Lambda", "Ξ": r"\Xi", "Π": r"\Pi", "Σ": r"\Sigma",
    "Υ": r"\Upsilon", "Φ": r"\Phi", "Ψ": r"\Psi", "Ω": r"\Omega",
    "∑": r"\sum", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "∏": r"\prod", "∂": r"\partial", "∇": r"\nabla",
    "∞": r"\infty", "√": r"\sqrt", "∝": r"\propto",
    "∈": r"\in", "∉": r"\notin", "∋": r"\ni", "∅": r"\emptyset", "⊂": r"\subset", "⊃": r"\supset", "⊆": r"\subseteq",
    "⊇": r"\supseteq", "∪": r"\cup", "∩": r"\cap", "∀": r"\forall", "∃": r"\exists", "¬": r"\neg", "∧": r"\wedge", "∨": r"\vee",
    "→": r"\to", "←": r"\leftarrow", "↔": r"\leftrightarrow", "⇒": r"\Rightarrow", "⇐": r"\Leftarrow", "⇔": r"\Leftrightarrow",
    "↑": r"\uparrow", "↓": r"\downarrow", "↕": r"\updownarrow", "⇑": r"\Uparrow", "⇓": r"\Downarrow",
    "≠": r"\neq", "≤": r"\leq", "≥": r"\geq", "≈": r"\approx", "≡": r"\equiv", "≅": r"\cong", "∼": r"\sim", "≪": r"\ll",
    "≫": r"\gg", "∥": r"\parallel", "⊥": r"\perp", "±": r"\pm", "∓": r"\mp", "×": r"\times", "÷": r"\div", "·": r"\cdot",
    "⊗": r"\otimes", "⊕": r"\oplus", "⟨": r"\langle", "⟩": r"\rangle", "‖": r"\|", "⌈": r"\lceil", "⌉": r"\rceil",
    "⌊": r"\lfloor", "⌋": r"\rfloor", "…": r"\ldots", "⋯": r"\cdots", "⋮": r"\vdots", "⋱": r"\ddots", "°": r"^{\circ}",
    "′": "'", "″": "''", "ℝ": r"\mathbb{R}", "ℤ": r"\mathbb{Z}", "ℕ": r"\mathbb{N}", "ℚ": r"\mathbb{Q}", "ℂ": r"\mathbb{C}",
    "ℓ": r"\ell", "ℏ": r"\hbar", "&": r"\&", "%": r"\%", "#": r"\#",
}
#: Functions that LaTeX has, and those that need a name of their own.
FUNCTION = {
    "sin": r"\sin", "cos": r"\cos", "tan": r"\tan", "cot": r"\cot", "sec": r"\sec", "csc": r"\csc", "arcsin": r"\arcsin", "arccos": r"\arccos",
    "arctan": r"\arctan", "sinh": r"\sinh", "cosh": r"\cosh", "tanh": r"\tanh", "exp": r"\exp", "log": r"\log", "ln": r"\ln", "lg": r"\lg",
    "lim": r"\lim", "inf": r"\inf", "sup": r"\sup", "max": r"\max", "min": r"\min", "det": r"\det", "dim": r"\dim", "ker": r"\ker",
    "deg": r"\deg", "gcd": r"\gcd", "rank": r"\operatorname{rank}", "lcm": r"\operatorname{lcm}", "tr": r"\operatorname{tr}",
    "div": r"\operatorname{div}", "curl": r"\operatorname{curl}", "grad": r"\operatorname{grad}",
}
#: Accents by combining character.
ACCENT = {"\u0302": "hat", "\u0303": "tilde", "\u0304": "bar", "\u0300": "grave", "\u0301": "acute", "\u0308": "ddot", "\u0307": "dot", "\u20d7": "vec", "\u0306": "breve", "\u030c": "check", "\u030a": "mathring"}
#: Delimiters, as they stand after \left and \right.
DELIMITER = {"(": "(", ")": ")", "[": "[", "]": "]", "{": r"\{", "}": r"\}", "|": "|", "‖": r"\|", "⌈": r"\lceil", "⌉": r"\rceil", "⌊": r"\lfloor", "⌋": r"\rfloor", "⟨": r"\langle", "⟩": r"\rangle", "": "."}
#: Matrix environments by delimiters, and marks over and under groups.
MATRIX = {("(", ")"): "pmatrix", ("[", "]"): "bmatrix", ("{", "}"): "Bmatrix", ("|", "|"): "vmatrix", ("‖", "‖"): "Vmatrix", ("", ""): "matrix"}
GROUP = {"⏞": "overbrace", "⏟": "underbrace", "⎵": "underbrace", "‾": "overline", "_": "underline"}
#: Elements that only describe others.
SILENT = {"chr", "pos", "type", "val", "begChr", "endChr", "sepChr", "degHide", "limLoc", "mcs", "mc", "mcPr", "count", "mcJc", "b", "sty", "brk"}


def symbols(text: str) -> str:
    return "".join(SYMBOL.get(c, c) for c in text)


#: What TeX takes as one argument without braces: a character, a command, or a group.
ONE_TOKEN = re.compile(r"\\[a-zA-Z]+|\{.*\}|.", re.DOTALL)


def grouped(part: str) -> str:
    """A script's argument, in braces unless it is one token."""
    part = part.strip()
    return part if ONE_TOKEN.fullmatch(part) else f"{{{part}}}"


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


class Formula:
    """An element with access to its parts, converted, and its properties."""

    def __init__(self, node: ET.Element):
        self.node = node

    def part(self, name: str) -> str:
        child = self.node.find(f"{{{MATH}}}{name}")
        return "" if child is None else inside(child)

    def parts(self, name: str) -> list[str]:
        return [inside(c) for c in self.node.findall(f"{{{MATH}}}{name}")]

    def has(self, *path: str) -> bool:
        return self.node.find("/".join(f"{{{MATH}}}{p}" for p in path)) is not None

    def value(self, default: str, *path: str, absent: str | None = None) -> str:
        """A property's value: `default` where the property is missing, `absent` where only its value is."""
        at = self.node.find("/".join(f"{{{MATH}}}{p}" for p in path))
        return default if at is None else at.get(f"{{{MATH}}}val", default if absent is None else absent)


#: Spellings of a property that is on.
ON = ("1", "true", "on")


def _run(f: Formula) -> str:
    """The texts of a run. Its style is plain (upright), bold, italic or both bold and italic; normal text is upright too."""
    text = "".join(symbols(t.text or "") for t in f.node.findall(f"{{{MATH}}}t"))
    style = f.value("", "rPr", "sty", absent="i")
    upright = style == "p" or f.has("rPr", "nor") and f.value("1", "rPr", "nor", absent="1") in ON
    if not text:
        return ""
    if style == "bi":
        return rf"\boldsymbol{{{text}}}"
    if style == "b" or f.has("rPr", "b"):
        return rf"\mathbf{{{text}}}"
    return rf"\mathrm{{{text}}}" if upright and text.isalpha() else text


def _fraction(f: Formula) -> str:
    shape = {"lin": "{0}/{1}", "skw": "{0}\\!/{1}", "noBar": r"\binom{{{0}}}{{{1}}}"}.get(f.value("", "fPr", "type"), r"\frac{{{0}}}{{{1}}}")
    return shape.format(f.part("num"), f.part("den"))


def _root(f: Formula) -> str:
    """A root, with its degree where there is one that is not hidden."""
    shown = not (f.has("radPr", "degHide") and f.value("1", "radPr", "degHide", absent="1") in ON)
    degree = f.part("deg").strip() if shown else ""
    return rf"\sqrt{f'[{degree}]' if degree else ''}{{{f.part('e')}}}"


def _large(f: Formula) -> str:
    """A large operator; its limits stand in braces, or as scripts where the operator has them at its side."""
    sign = f.value("", "naryPr", "chr") or "∑"
    beside = f.value("undOvr", "naryPr", "limLoc") == "subSup"
    out = SYMBOL.get(sign, sign)
    for mark, limit in (("_", f.part("sub")), ("^", f.part("sup"))):
        if limit:
            out += mark + (grouped(limit) if beside else f"{{{limit}}}")
    return f"{out} {f.part('e')}"


def _function(f: Formula) -> str:
    name = f.part("fName").strip()
    return rf"{FUNCTION.get(name.replace(chr(92), '').strip(), name)}\left({f.part('e').strip()}\right)"


def _between(f: Formula) -> str:
    begin, end = f.value("(", "dPr", "begChr"), f.value(")", "dPr", "endChr")
    mark = f.value(",", "dPr", "sepChr")
    left, right = (side + DELIMITER[c] if c in DELIMITER else c for side, c in ((r"\left", begin), (r"\right", end)))
    return left + f" {SYMBOL.get(mark, mark)} ".join(f.parts("e")) + right


def _environment(name: str, rows: list[str]) -> str:
    return f"\\begin{{{name}}}\n" + " \\\\\n".join(rows) + f"\n\\end{{{name}}}"


def _matrix(f: Formula) -> str:
    rows = [" & ".join(Formula(r).parts("e")) for r in f.node.findall(f"{{{MATH}}}mr")]
    return _environment(MATRIX.get((f.value("(", "mPr", "begChr"), f.value(")", "mPr", "endChr")), "pmatrix"), rows)


def _accent(f: Formula) -> str:
    mark = f.value("\u0302", "accPr", "chr")
    return rf"\{ACCENT.get(mark, ACCENT.get(mark.strip(), 'hat'))}{{{f.part('e')}}}"


def _group(f: Formula) -> str:
    command = GROUP.get(f.value("⏞", "groupChrPr", "chr"), "overbrace")
    if f.value("top", "groupChrPr", "pos") == "bot":
        command = command.replace("over", "under")
    return rf"\{command}{{{f.part('e')}}}"


TEMPLATE: dict[str, Callable[[Formula], str]] = {
    "r": _run,
    "t": lambda f: symbols(f.node.text or ""),
    "f": _fraction,
    "sSup": lambda f: f"{f.part('e')}^{grouped(f.part('sup'))}",
    "sSub": lambda f: f"{f.part('e')}_{grouped(f.part('sub'))}",
    "sSubSup": lambda f: f"{f.part('e')}_{grouped(f.part('sub'))}^{grouped(f.part('sup'))}",
    "sPre": lambda f: "".join(m + grouped(f.part(p)) for m, p in (("^", "sup"), ("_", "sub")) if f.part(p)) + f.part("e"),
    "rad": _root,
    "nary": _large,
    "func": _function,
    "limLow": lambda f: f"{f.part('e')}_{{{f.part('lim')}}}",
    "limUpp": lambda f: f"{f.part('e')}^{{{f.part('lim')}}}",
    "d": _between,
    "m": _matrix,
    "eqArr": lambda f: _environment("aligned", f.parts("e")),
    "bar": lambda f: rf"\{'underline' if f.value('top', 'barPr', 'pos') == 'bot' else 'overline'}{{{f.part('e')}}}",
    "acc": _accent,
    "groupChr": _group,
    "borderBox": lambda f: rf"\boxed{{{f.part('e')}}}",
    "phant": lambda f: rf"\phantom{{{f.part('e')}}}",
}


def latex_of(node: ET.Element) -> str:
    name = _name(node)
    if name in TEMPLATE:
        return TEMPLATE[name](Formula(node))
    return "" if name in SILENT or name.endswith("Pr") else inside(node)


def inside(node: ET.Element) -> str:
    return "".join(latex_of(c) for c in node)


def tidy(latex: str) -> str:
    for pattern, to in ((r"[ \t]+", " "), (r"\s+([_^])\s*", r"\1"), (r"\{\}\{\}", "{}"), (r"\\left\.\s*\\right\.", "")):
        latex = re.sub(pattern, to, latex)
    latex = latex.strip()
    return latex if any(c.isalnum() or c in "\\{}^_" for c in latex) else ""


def _parsed(xml: str) -> ET.Element | None:
    for text in (xml, f'<m:oMath xmlns:m="{MATH}" xmlns:w="{WORD}">{xml}</m:oMath>'):
        try:
            return ET.fromstring(text)
        except ET.ParseError:
            continue
    return None


def to_latex(xml: str | None) -> str | None:
    """LaTeX of a formula; its bare text where the structure gives nothing; null for what is no formula."""
    if not xml or not xml.strip().startswith("<"):
        return None
    root = _parsed(xml)
    if root is None:
        return None
    found = tidy(latex_of(root))
    words = " ".join(t.text for t in root.iter(f"{{{MATH}}}t") if t.text)
    return found or (symbols(words.strip()) or None)


def convert(rows: DataFrame, xml: str, out: str) -> DataFrame:
    """Adds LaTeX; each distinct formula is converted once."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_latex(x) for x in batch.column(0).to_pylist()], pa.string())], names=["_xml", out])

    done = rows.select(F.col(xml).alias("_xml")).where("_xml is not null").distinct().mapInArrow(work, f"_xml string, {out} string")
    return rows.join(done, F.col(xml) == F.col("_xml"), "left").drop("_xml")

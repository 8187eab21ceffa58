import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import latex
from scriptorium.functions import text as T
from scriptorium.functions.pyre import safe_name, title_case
from scriptorium.operators import classify, sequence


def one(spark, column, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return d.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,tokens", [("", 1), ("abcdef", 2), (r"\frac{a}{b}", 3), ("x" * 240_000, 80_000), ("x" * 240_003, 80_001)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, T.token_estimate(F.col("t")), t=text) == tokens


@pytest.mark.parametrize("tokens,mode", [(80_000, "RAW_CLEAN"), (80_001, "DENSE"), (180_000, "DENSE"), (180_001, "OUTLINE")])
def test_mode(spark, tokens, mode):
    assert one(spark, T.compression_mode(F.col("n")), n=tokens) == mode


def test_truncate(spark):
    got = one(spark, T.truncate(F.col("t"), F.lit(10)), t="a" * 9 + "\n" + "b" * 5)
    assert got.startswith("a" * 9 + "\n\n[... 6 ")
    got = one(spark, T.truncate(F.col("t"), F.lit(10)), t="a" * 8 + "\n" + "b" * 6)
    assert got.startswith("a" * 8 + "\nb\n\n[... 5 ")
    assert one(spark, T.truncate(F.col("t"), F.lit(10)), t="short") == "short"
    assert "1,234 caratteri" in one(spark, T.truncate(F.col("t"), F.lit(10)), t="x" * 1244)


@pytest.mark.parametrize("text,want", [("ffiilliippppoo", "filippo"), ("aabbcdefgh", "aabbcdefgh"), ("", "")])
def test_doubled(spark, text, want):
    assert one(spark, T.repair_doubled(F.col("t")), t=text) == want


def plain_clean(text):
    """An independent model of cleaning."""
    for p, f in [(r"\bpag(?:ina|\.?)?\s*\d+\b", re.I), (r"^\s*\d+\s*$", re.M), (r"^\s*[-–—]+\s*$", re.M), (r"\[\d{2}:\d{2}\]\s*", re.M), (r"©.*?(?:\n|$)", re.I), (r"slide\s+\d+\s*/\s*\d+", re.I), (r"department\s+of\s+\w+.*?\n", re.I), (r"university\s+of\s+\w+.*?\n", re.I), (r"a\.y\.\s*\d{4}[-/]\d{2,4}.*?\n", re.I)]:
        text = re.sub(p, "", text, flags=f)
    out = []
    for line in (x.rstrip() for x in text.split("\n")):
        before = out[-1] if out else ""
        if before and line[:1].islower() and before[-1] not in '.!?:;)]"' and len(before) < 80:
            out[-1] = f"{before} {line}"
        else:
            out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def test_clean_against_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    noisy = []
    for r in docs:
        w = r["text"].split()
        noisy.append((r["doc_id"], "© 2020 x\n[01:02] " + "\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5)) + "\n 12 \nPag. 4\n---\nSlide 3 / 9\nUniversity of Étude x\nfin"))
    noisy += [(-1, ""), (-2, "a.y. 2020/21 x\nla\u00a0\nÈ\nè qui\n\n\n\nfine"), (-3, None)]
    d = spark.createDataFrame(noisy, "id long, text string")
    got = {r["id"]: r["c"] for r in d.select("id", T.clean(F.col("text")).alias("c")).collect()}
    assert got == {i: plain_clean(t or "") for i, t in noisy}
    assert sum(got[i] != t for i, t in noisy) > 50


@pytest.mark.parametrize("text,inside", [("\\", r"\textbackslash{}"), ("a & b", r"\&"), ("50%", r"\%"), ("$100", r"\$"), ("#1", r"\#"), ("x_n", r"\_"), ("{a}", r"\{a\}"), ("~", r"\textasciitilde{}"), ("<tag>", r"\textless{}tag\textgreater{}"), ("α≤β", r"$\alpha$$\leq$$\beta$"), ("𝑥ℎ𝑨", r"$x$$h$$\boldsymbol{A}$"), ("²₃", "$^{2}$$_{3}$"), ("dell'analisi", "dell'analisi")])
def test_escape(spark, text, inside):
    got = one(spark, latex.escape(F.col("t")), t=text)
    assert inside in got
    assert got.count("textbackslash") == text.count("\\")


def test_maps_have_the_known_sizes():
    assert (len(latex.text_map()), len(latex.formula_map())) == (208, 195)


@pytest.mark.parametrize("lang,want", [("it", "italian"), ("en", "english"), ("fr", "french"), ("de", "ngerman"), ("catalan", "catalan"), ("xx", "xx")])
def test_header(spark, lang, want):
    got = one(spark, latex.header(F.col("t")), t=lang)
    assert f"[{want}]{{babel}}" in got and "BABEL" not in got


def test_text_block(spark):
    got = one(spark, latex.text_block(F.col("t")), t="Uno\n• a\n- b & c\n\ndue")
    assert got == "Uno\n\\begin{itemize}\n  \\item a\n  \\item b \\& c\n\\end{itemize}\n\ndue"


def test_answer_cleanup(spark):
    text = "Ecco:\n```latex\n\\section{A}\n\\begin{x}\n\\end{x}\n\\subsection{B} testo\n\\end{document}\n```\nFine"
    assert one(spark, T.clean_answer(F.col("t")), t=text).endswith("\\end{document}")
    assert one(spark, T.clean_answer(F.col("t"), compat=True), t=text).endswith("\\end{x}")
    assert one(spark, T.clean_answer(F.col("t")), t="plain") == "plain"


def test_small_text_rules(spark):
    assert one(spark, title_case(F.col("t")), t="ALFA-BETA dell'analisi") == "Alfa-Beta Dell'Analisi"
    assert one(spark, safe_name(F.col("t")), t="../a/b c!.") == "a_b c"
    assert one(spark, safe_name(F.col("t")), t="!!!") == "output"
    assert one(spark, T.strip_rtf(F.col("t")), t="{\\rtf1{\\fonttbl x;} " + "caff\\'e8\\par fine " * 30 + "}") == "\n ".join(["caffè"] + ["fine caffè"] * 29 + ["fine"])
    assert one(spark, T.strip_rtf(F.col("t")), t="plain {x}") == "plain {x}"
    assert one(spark, T.fix_ocr(F.col("t")), t="alpha + beta = O") == r"\alpha+\beta=0"
    assert one(spark, T.fix_ocr(F.col("t")), t="x") is None
    assert one(spark, F.array_join(T.wrap(F.col("t"), 7), "|"), t="uno due tre quattro") == "uno due|tre|quattro"
    assert one(spark, T.drop_footers(F.col("t")), t="a\nx@y.org\nhttp://a.b/c\n3 / 47\n1/2 + 1") == "a\n1/2 + 1"
    assert one(spark, T.bare_latex(F.col("t")), t="$$ x $$") == "x"


@pytest.mark.parametrize("text,ok", [("..", False), ("ab", False), ("12", False), ("x^2", True), ("", False), ("èèèèè=", False), ("a+b", True)])
def test_plausible(spark, text, ok):
    assert one(spark, T.plausible_latex(F.col("t")), t=text) is ok


@pytest.mark.parametrize("n,stamped,ok", [(10, 3, True), (10, 2, False), (20, 2, True), (20, 1, False)])
def test_transcript_rule(spark, n, stamped, ok):
    text = "\n".join(["[00:01] x"] * stamped + ["y"] * (n - stamped)) + "\n\n"
    assert one(spark, classify.is_transcript(F.col("t")), t=text) is ok


@pytest.mark.parametrize("text,want", [("il sistema di controllo del circuito", "ingegneria"), ("teorema e dimostrazione", "matematica"), ("la forza e l'energia", "fisica"), ("paziente con diagnosi e terapia", "medicina"), ("mercato, prezzo", "economia"), ("una legge", "generico"), ("", "generico"), ("campo", "generico")])
def test_subject(spark, text, want):
    assert one(spark, classify.subject(F.col("t")), t=text) == want


def test_subject_hint(spark):
    assert one(spark, classify.subject(F.lit(""), F.col("t")), t="corso di Fisica 2") == "fisica"
    assert one(spark, classify.subject(F.lit(""), F.col("t")), t="medic") == "medicina"


def test_formula_image(spark):
    rows = [("png", 300, 80, .9, .1, .0, True), ("png", 15, 8, .9, .1, .0, False), ("png", 2100, 900, .9, .1, .0, False), ("png", 300, 80, .1, .9, .0, False), ("png", 50, 200, .9, .1, .0, False), ("png", 200, 100, .9, .1, .5, False), ("wmf", 300, 80, .9, .1, .0, False), ("png", None, 80, .9, .1, .0, False)]
    d = spark.createDataFrame(rows, "e string, w int, h int, l double, d double, s double, want boolean")
    got = d.select(classify.is_formula_image(*[F.col(c) for c in "ewhlds"]).alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]


def test_math(spark):
    d = spark.createDataFrame([("a $$x+1$$ b \\begin{align}y\\end{align} c $z^2$ $$w+2$$",)], "t string")
    r = sequence.extract_math(d, "t").first()
    assert r["t"] == "a [FORMULA_1] b [FORMULA_3] c $z^2$ [FORMULA_2]"
    assert r["formulas"] == ["$$x+1$$", "$$w+2$$", "\\begin{align}y\\end{align}", "$z^2$"]

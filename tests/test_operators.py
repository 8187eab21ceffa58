import hashlib
import io
import json
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.formulas import MATH, convert, to_latex
from scriptorium.operators import context, jobs, merge, render, sequence
from scriptorium.plans import catalogue, intake, sequences, state
from scriptorium.plans.normalize import normalize
from scriptorium.sources import connectors, files


@pytest.mark.parametrize("times,n,want", [((0, 60, 120), 3, [0, 1, 2]), ((0, 300, 360), 3, [0, 1, 2]), ((0, 10, 20, 30, 40), 3, [0, 0, 1, 2, 2]), ((0, 50, 0, 10), 2, [0, 1, 0, 1]), ((5,), 3, [0])])
def test_align(spark, times, n, want):
    d = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "k string, seq int, t int")
    got = sequence.align_timed(d, "k", ["seq"], "t", F.lit(n)).orderBy("seq").collect()
    assert [r["idx"] for r in got] == want


def test_align_uniform(spark):
    d = spark.createDataFrame([("a", i) for i in range(7)], "k string, seq int")
    assert [r["idx"] for r in sequence.align_uniform(d, "k", ["seq"], F.lit(3)).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2, 2]


def test_transcript_and_slides(spark):
    d = spark.createDataFrame([("a", "[00:05] ciao\n[1:02:03] x\n[100:05] perso\nrumore\n[00:07] \nriga dopo", "--- SLIDE 1: Titolo ---\ncorpo\n--- slide 2 ---\naltro")], "k string, t string, s string")
    got = [(r["time_sec"], r["text"]) for r in sequence.parse_transcript(d, "k", F.col("t")).orderBy("seq").collect()]
    assert got == [(5, "ciao"), (3723, "x"), (7, "riga dopo")]
    assert sequence.parse_transcript(d, "k", F.col("t"), long_minutes=True).count() == 4
    got = [(r["slide_num"], r["title"], r["body"]) for r in sequence.parse_slides(d, "k", F.col("s")).orderBy("slide_pos").collect()]
    assert got == [(1, "Titolo", "corpo"), (2, "", "altro")]


def test_dedup_limits(spark):
    rows = [("a", i, t) for i, t in enumerate(["x" * 19, "X" * 19, "y" * 20, "Y " * 20, "É" * 20, "é" * 20])]
    d = spark.createDataFrame(rows, "k string, pos int, line string")
    assert [r["pos"] for r in sequence.dedup_first(d, ["k"], "pos", "line").orderBy("pos").collect()] == [0, 1, 2, 4]


@pytest.mark.parametrize("pages,want", [(20, [None] * 20), (21, [0] * 7 + [1] * 7 + [2] * 7)])
def test_chunks(spark, pages, want):
    d = spark.createDataFrame([("a", 3 * i) for i in range(pages)], "k string, page int")
    assert [r["chunk"] for r in sequence.chunk_pages(d, "k", "page").orderBy("page").collect()] == want


def test_sections(spark):
    text = "--- SLIDE 3 ---\nuno\n[00:12] due\n[00:13]\nANALISI MATEMATICA\ntre"
    rows = sequence.explode_lines(spark.createDataFrame([("a", text)], "k string, t string"), "k", "t")
    got = [(r["heading"], r["body"]) for r in sequence.parse_sections(rows, "k", "pos", "line").orderBy("sid").collect()]
    assert got == [("Slide / Pagina 3", "uno\ndue"), ("Analisi Matematica", "tre")]


def test_merges(spark):
    p = spark.createDataFrame([(1, "x" * 79), (2, "y" * 80)], "page int, text string")
    o = spark.createDataFrame([(1, "o1"), (2, "o2"), (3, "o3")], "page int, text string")
    add = {r["page"]: r["text"] for r in merge.enrich_sparse(p, o, ["page"], "text", True).collect()}
    put = {r["page"]: r["text"] for r in merge.enrich_sparse(p, o, ["page"], "text", False).collect()}
    assert add == {1: "x" * 79 + "\no1", 2: "y" * 80, 3: "o3"}
    assert put == {1: "o1", 2: "y" * 80, 3: "o3"}


def test_context_limits(spark):
    d = spark.createDataFrame([("c", n, ["k"]) for n in range(1, 12)], "course string, number int, concepts array<string>")
    got = {r["number"]: r["concepts"] for r in context.compact(d, "course", "number", ["concepts"]).collect()}
    assert got[1] is None and got[2] == ["k"]
    s = spark.createDataFrame([("c", f"s{i}", "v", i) for i in range(51)] + [("c", "s5", "new", 99)], "course string, symbol string, meaning string, seq int")
    got = {r["symbol"]: (r["meaning"], r["place"]) for r in context.merge_symbols(s, "course", "symbol", "meaning", F.col("seq")).collect()}
    assert len(got) == 50 and "s0" not in got and got["s5"] == ("new", 5)


def test_eviction_and_admission(spark):
    for finished, left in ((1, 200), (0, 201)):
        d = spark.createDataFrame([(i, "done" if i < finished else "running") for i in range(201)], "created int, status string")
        assert jobs.evict(d, "status", ["created"]).count() == left
    d = spark.createDataFrame([("a", "running")] + [("a", "queued")] * 5 + [("b", "running")] * 2, "k string, status string")
    assert {r["k"]: r["admitted"] for r in jobs.admits(d, ["k"], "status", 2).collect()} == {"a": True, "b": False}


def test_top_images(spark):
    d = spark.createDataFrame([("a", i) for i in range(25)], "k string, n int")
    assert sorted(r["n"] for r in render.top_images(d, "k", ["n"]).collect()) == list(range(20))


RUN = "<m:r><m:t>{}</m:t></m:r>"
CASES = [
    ("<m:f><m:num>{a}</m:num><m:den>{b}</m:den></m:f>", r"\frac{a}{b}"),
    ("<m:sSup><m:e>{x}</m:e><m:sup>{2}</m:sup></m:sSup>", "x^2"),
    ("<m:sSub><m:e>{a}</m:e><m:sub>{n}</m:sub></m:sSub>", "a_n"),
    ('<m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg/><m:e>{x}</m:e></m:rad>', r"\sqrt{x}"),
    ("<m:rad><m:deg>{3}</m:deg><m:e>{x}</m:e></m:rad>", r"\sqrt[3]{x}"),
    ('<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{i=0}</m:sub><m:sup>{n}</m:sup><m:e>{x}</m:e></m:nary>', r"\sum_{i=0}^{n} x"),
    ("{α}", r"\alpha"),
    ('<m:f><m:fPr><m:type m:val="noBar"/></m:fPr><m:num>{n}</m:num><m:den>{k}</m:den></m:f>', r"\binom{n}{k}"),
    ('<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val="]"/></m:dPr><m:e>{x}</m:e></m:d>', r"\left[x\right]"),
    ('<m:d><m:dPr><m:begChr m:val="|"/><m:endChr m:val="|"/></m:dPr><m:e>{x}</m:e></m:d>', r"\left|x\right|"),
    ('<m:acc><m:accPr><m:chr m:val="\u0302"/></m:accPr><m:e>{x}</m:e></m:acc>', r"\hat{x}"),
    ("<m:m><m:mr><m:e>{a}</m:e><m:e>{b}</m:e></m:mr><m:mr><m:e>{c}</m:e><m:e>{d}</m:e></m:mr></m:m>", "\\begin{pmatrix}\na & b \\\\\nc & d\n\\end{pmatrix}"),
    ("<m:func><m:fName>{sin}</m:fName><m:e>{x}</m:e></m:func>", r"\sin\left(x\right)"),
    ("<m:limLow><m:e>{lim}</m:e><m:lim>{n}</m:lim></m:limLow>", "lim_{n}"),
    ('<m:bar><m:barPr><m:pos m:val="bot"/></m:barPr><m:e>{x}</m:e></m:bar>', r"\underline{x}"),
    ("<m:sPre><m:sub>{a}</m:sub><m:sup>{bc}</m:sup><m:e>{x}</m:e></m:sPre>", "^{bc}_ax"),
]


@pytest.mark.parametrize("body,want", CASES)
def test_formulas(body, want):
    import re

    xml = re.sub(r"\{([^}]+)\}", lambda m: RUN.format(m[1]), body)
    assert to_latex(f'<m:oMath xmlns:m="{MATH}">{xml}</m:oMath>') == want
    assert to_latex(xml) == want  # without a namespace


def test_formula_edges(spark):
    assert to_latex("") is None and to_latex(None) is None and to_latex("not xml") is None
    d = spark.createDataFrame([(1, RUN.format("π")), (2, None), (3, RUN.format("π"))], "k int, xml string")
    assert {r["k"]: r["tex"] for r in convert(d, "xml", "tex").collect()} == {1: r"\pi", 2: None, 3: r"\pi"}


def test_sources(spark, tmp_path):
    lesson = tmp_path / "lesson1"
    lesson.mkdir()
    (lesson / "b.txt").write_bytes("ciao \xe8\xff".encode("latin-1"))
    (lesson / ".hidden.txt").write_text("x")
    (lesson / "a.pdf").write_bytes(b"%PDF-1.4")
    (lesson / "z.exe").write_bytes(b"MZ")
    d = files.scan_folder(spark, str(tmp_path))
    assert [(r["name"], r["kind"], r["lesson"]) for r in files.ordered(d).collect()] == [("a.pdf", "pdf", "lesson1"), ("b.txt", "text", "lesson1")]
    assert files.texts(d).first()["text"].startswith("ciao")
    got = connectors.run(d.where("kind = 'pdf'"), "pdf").first()
    assert got["attempted"] and got["result"] is None and got["error"]
    r = spark.createDataFrame([("u?altTranscode=1&x=1", "u&altTranscode=1&x=1")], "a string, b string").select(files.drop_parameter(F.col("a")), files.cut_url(F.col("b"))).first()
    assert tuple(r) == ("u&x=1", "u")


def test_docx(spark):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "<w:p>{}<w:r><w:t>{}</w:t></w:r></w:p>"
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    row = "<w:tr>" + cell.format("a") + cell.format("b") + "</w:tr>"
    body = p.format('<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>', "Titolo") + p.format("", "testo") + f"<w:tbl>{row}{row}</w:tbl>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert connectors.docx_text(buf.getvalue()) == "## Titolo\ntesto\n[TABELLA]\na | b"


def test_normalize(spark):
    rows = [("a", "Lezione", "[00:00] teorema uno\n[01:00] dimostrazione", "--- SLIDE 1: A ---\nIl teorema\n--- SLIDE 2 ---\nAltro", "Il documento $x^2$", None, None),
            ("b", "Vuota", "", "", "PARTE PRIMA ALFA\nTesto lungo abbastanza per contare\n\nTesto lungo abbastanza per contare", "fisica", "CTX")]
    d = spark.createDataFrame(rows, "k string, title string, transcript string, slides string, extra string, hint string, context string")
    got = {r["k"]: r for r in normalize(d, "k").collect()}
    assert got["a"]["subject"] == "matematica" and got["b"]["subject"] == "fisica"
    assert "### Slide 1: A\n[CONTENUTO SLIDE]\nIl teorema\n[SPIEGAZIONE ORALE]\nteorema uno" in got["a"]["prompt"]
    assert got["a"]["formulas"] == ["$x^2$"] and "Formule estratte" not in got["a"]["prompt"]
    assert got["b"]["prompt"].startswith("CTX\n\nTIPO DI CORSO: fisica\n\n# Vuota")
    assert [s["heading"] for s in got["b"]["sections"]] == ["", "Parte Prima Alfa"]


def test_sql_functions(spark):
    from scriptorium.functions import sql

    names = sql.register(spark)
    d = spark.createDataFrame([("[00:01] Uno % due $x$\n\ntre {a}\nè qui",), ("",), (None,)], "t string")
    d.createOrReplaceTempView("texts_of_test")
    for name in sql.SCALAR:
        assert name in names
        by_sql = [r[0] for r in spark.sql(f"select {name}(t) from texts_of_test").collect()]
        assert by_sql == [r["x"] for r in sql.apply_scalar(d, name, "t", "x").collect()]
    assert spark.sql(f"select omml_to_latex('{RUN.format('π')}')").first()[0] == r"\pi"


def test_answers_fall_back(spark):
    d = spark.createDataFrame([(1, "p1", "skeleton"), (2, "bad", "skeleton")], "k int, prompt string, skeleton string")

    def call(prompt):
        if prompt == "bad":
            raise RuntimeError("no answer")
        return f"```latex\n\\section{{{prompt}}}\n```"

    got = {r["k"]: (r["answer"], r["error"]) for r in connectors.answers(d, "prompt", "skeleton", call).collect()}
    assert got == {1: (r"\section{p1}", None), 2: ("skeleton", "no answer")}
    assert [r["answer"] for r in connectors.answers(d, "prompt", "skeleton").collect()] == ["skeleton"] * 2


def test_every_page_has_a_label_of_its_own(spark):
    """All pages of a table with numbers of four digits, which stay whole."""
    got = {r["page_id"]: r["tex"] for r in state.page_skeleton(spark, "/root/testdata/sf0.1").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id").collect()
    assert set(got) == {r["page_id"] for r in pages} and max(got) > 999
    assert all(f"-pag{k:03d}}}\n" in tex for k, tex in got.items())


def test_eviction_over_all_jobs(spark):
    """Against sorting in Python: all events, jobs of equal and of null time; no step takes more rows than the cap."""
    e = state._jobs(spark, "/root/testdata/sf0.01").select("event_id", "ts", "status")
    rows = [tuple(r) for r in e.collect()]
    active = {i for i, _, s in rows if s not in jobs.FINISHED}
    old = sorted((t, i) for i, t, s in rows if s in jobs.FINISHED)
    for cap in (200, len(active) + 77):
        got = [r["event_id"] for r in jobs.evict(e, "status", ["ts", "event_id"], cap).collect()]
        assert sorted(got) == sorted(active | {i for _, i in old[len(rows) - cap :]}) and len(rows) > 1000
    d = spark.createDataFrame([(None if i < 3 else i // 2, "done" if i < 290 else "running") for i in range(300)], "created int, status string")
    left = jobs.evict(d, "status", ["created"])
    assert left.count() == 200 and left.where("created is null").count() == 0
    taken = re.findall(r"TakeOrderedAndProject\(limit=(\d+)|(?:Collect|Local|Global)Limit (\d+)", jobs.evict(e, "status", ["ts", "event_id"], len(active) + 77)._jdf.queryExecution().executedPlan().toString())
    assert taken and all(int(a or b) <= 77 for a, b in taken)


def test_chunks_hold_whole_texts(spark):
    """All documents of a table by brute force."""
    sf, by, want = "/root/testdata/sf0.01", {}, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "text").collect():
        by.setdefault(f"{r['source']}-{r['doc_id'] // 1000}", []).append((r["doc_id"], r["text"]))
    for lesson, docs in by.items():
        pages = list(enumerate(sorted(docs), 1)) if len(docs) > 20 else []
        for k in range(0, len(pages), 7):
            want[lesson, k // 7] = "\n\n".join(f"[PAG {p}]\n{t}" for p, (_, t) in pages[k : k + 7])
    got = {(r["lesson"], r["chunk"]): r["text"] for r in sequences.chunk_pages(spark, sf).collect()}
    assert got == want and max(map(len, got.values())) > 10_000


def deck(*slides):
    return bytearray(intake.presentation(list(slides)))


def test_slides_of_a_presentation(spark):
    """Objects from top to bottom, formulas as LaTeX, pictures by digest, notes that are no prompt; a broken file is an error."""
    one = {"title": "Titolo", "notes": "una nota", "shapes": [("text", 30, "sotto"), ("text", 10, "sopra"), ("omml_formula", 20, "π"), ("image", 40, b"PNG"), ("table", 25, [["a", "b"], ["c"]])]}
    two = {"title": "", "notes": "Fare clic per modificare", "shapes": []}
    d = spark.createDataFrame([(1, "x", deck(one, two)), (2, "y", bytearray(b"no zip")), (3, "z", None)], "k int, title_of string, content binary")
    rows = {(r["k"], r["slide_number"]): r for r in connectors.slides(d, "content").collect()}
    assert set(rows) == {(1, 1), (1, 2), (2, None), (3, None)} and rows[2, None]["error"] and rows[3, None]["error"]
    first = rows[1, 1]
    assert [(o["obj_type"], o["latex_result"] or o["content"]) for o in first["objects"]][:2] == [("text", "sopra"), ("omml_formula", r"\pi")]
    assert [o["obj_type"] for o in first["objects"]] == ["text", "omml_formula", "table", "text", "image"]
    assert first["objects"][2]["content"].count("\\hline") == 3 and first["objects"][4]["content"] == hashlib.md5(b"PNG").hexdigest()
    assert (first["title"], first["notes"], first["title_of"]) == ("Titolo", "una nota", "x")
    assert rows[1, 2]["objects"] == [] and rows[1, 2]["notes"] == ""
    text = connectors.pptx_text(bytes(deck(one, two)))
    assert text.startswith("--- SLIDE 1: Titolo ---\nsopra\n[FORMULA: \\pi]\n[TABELLA: a | b\nc]\nsotto") and text.endswith("--- SLIDE 2 ---")


def package(parts):
    """A PPTX file by hand: part names and their XML."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


SPACES = (
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
    'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
)


def shape(text, y, inner=""):
    return f'<p:sp><p:spPr><a:xfrm><a:off x="4" y="{y}"/><a:ext cx="10" cy="20"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r>{inner}</a:p></p:txBody></p:sp>'


def slide(body):
    return f"<p:sld {SPACES}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"


def relations(rows):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="x/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"


def test_slides_in_the_presentations_order(spark):
    """Slides moved by their author keep old part names, some are no longer listed; the same file twice is two rows."""
    parts = {
        "_rels/.rels": relations([("a", "officeDocument", "/deck/main.xml")]),
        "deck/main.xml": f'<p:presentation {SPACES}><p:sldIdLst><p:sldId r:id="c"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "deck/_rels/main.xml.rels": relations([("a", "slide", "slides/slide1.xml"), ("b", "slide", "slides/slide2.xml"), ("c", "slide", "slides/slide10.xml")]),
        "deck/slides/slide1.xml": slide(shape("one", 5)),
        "deck/slides/slide2.xml": slide(shape("gone", 5)),
        "deck/slides/slide10.xml": slide(shape("ten", 5)),
    }
    d = spark.createDataFrame([(1, package(parts)), (1, package(parts)), (2, package({"ppt/slides/slide10.xml": slide(shape("b", 1)), "ppt/slides/slide9.xml": slide(shape("a", 1))}))], "k int, content binary")
    got = sorted((r["k"], r["slide_number"], [o["content"] for o in r["objects"]]) for r in connectors.slides(d, "content").collect())
    assert got == [(1, 1, ["ten"]), (1, 1, ["ten"]), (1, 2, ["one"]), (1, 2, ["one"]), (2, 1, ["a"]), (2, 2, ["b"])]
    plan = connectors.slides(d, "content")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_shapes_of_groups(spark):
    """Shapes of nested groups stand where the groups put them; formulas in groups and in alternative content are read."""
    formula = '<m:oMath><m:r><m:t>π</m:t></m:r></m:oMath>'
    frame = lambda y, h, cy, ch: f'<p:grpSpPr><a:xfrm><a:off x="100" y="{y}"/><a:ext cx="50" cy="{h}"/><a:chOff x="0" y="{cy}"/><a:chExt cx="100" cy="{ch}"/></a:xfrm></p:grpSpPr>'
    inner = f"<p:grpSp>{frame(1000, 100, 0, 200)}{shape('deep', 100)}</p:grpSp>"
    choice = f"<mc:AlternateContent><mc:Choice Requires='a14'>{shape('', 3000, formula)}</mc:Choice><mc:Fallback>{shape('picture of it', 3000)}</mc:Fallback></mc:AlternateContent>"
    body = shape("first", 10) + f"<p:grpSp>{frame(500, 100, 1000, 1000)}{inner}{shape('late', 2000)}</p:grpSp>" + choice + shape("between", 503) + "<p:grpSp/>"
    content = package({"ppt/slides/slide1.xml": slide(body), "ppt/slides/slide2.xml": slide(f"<p:grpSp>{shape('', 7, formula)}</p:grpSp>")})
    rows = {r["slide_number"]: r["objects"] for r in connectors.slides(spark.createDataFrame([(1, content)], "k int, content binary"), "content").collect()}
    assert [(o["content"] if o["obj_type"] == "text" else o["latex_result"], o["top"]) for o in rows[1]] == [("first", 10), ("between", 503), ("deep", 505), ("late", 600), (r"\pi", 3000)]
    deep = rows[1][2]
    assert (deep["left"], deep["width"], deep["height"], deep["pos"]) == (151, 2, 1, 2)
    assert [o["obj_type"] for o in rows[2]] == ["omml_formula"]


def test_pictures_once_each(spark):
    one, two = {"title": "A", "notes": "", "shapes": [("image", 1, b"PNG")]}, {"title": "B", "notes": "", "shapes": [("image", 1, b"PNG"), ("text", 2, "t")]}
    found = connectors.slides(spark.createDataFrame([(1, deck(one, two)), (2, deck(two))], "k int, content binary"), "content")
    assert [(r["md5"], bytes(r["image"])) for r in connectors.pictures(found).collect()] == [(hashlib.md5(b"PNG").hexdigest(), b"PNG")]


def test_pages_of_two_readers(spark):
    """The denser text of each page; tables follow the first reader's text; pages that one reader lacks come from the other."""
    layout = [{"page": 1, "text": "a b c", "tables": [[["x", None], ["", " "], ["y", "z"]]]}, {"page": 2, "text": "w   i   d   e", "tables": []}, {"page": 4, "text": "", "tables": []}]
    blocks = [{"page": 1, "x0": 0, "y0": 0, "y1": 5, "text": "s p a r s e"}, {"page": 2, "x0": 0, "y0": 30, "y1": 40, "text": "second"}, {"page": 2, "x0": 0, "y0": 0, "y1": 8, "text": "first"}, {"page": 3, "x0": 0, "y0": 0, "y1": 8, "text": "alone"}]
    one = spark.createDataFrame([("f", json.dumps(layout)), ("g", None)], "md5 string, result string")
    two = spark.createDataFrame([("f", json.dumps(blocks)), ("g", json.dumps(blocks[-1:]))], "md5 string, result string")
    got = {(r["md5"], r["page"]): r["text"] for r in connectors.pdf_pages(one, two, "md5").collect()}
    assert got == {("f", 1): "a b c\n[TABELLA]\nx |\ny | z", ("f", 2): "first\n\nsecond", ("f", 3): "alone", ("g", 3): "alone"}


def test_binarised_pictures():
    gray = np.full((4, 6), 250, np.uint8)
    gray[1, 2:4] = 10
    out = connectors.binarised(gray, border=3)
    assert out.shape == (10, 12) and set(out.ravel()) == {0, 255} and (out == 0).sum() == 2 and out[4, 5] == 0
    assert connectors.placeholder_slide(3, "a < b").count("a &lt; b") == 1
    assert {"page_ocr", "page_ocr_ita", "page_ocr_eng", "pdf_layout", "pdf_blocks", "formula_text"} <= set(connectors._tools)


def test_batch_tools_take_a_batch_and_fall_back_to_single_calls(spark, monkeypatch):
    calls = []

    def together(contents):
        calls.append(len(contents))
        if b"bad" in contents:
            raise ValueError("bad content")
        return [c.decode() for c in contents]

    monkeypatch.setitem(connectors._tools, "test", lambda c: together([c])[0])
    monkeypatch.setitem(connectors._batch_tools, "test", together)
    d = spark.createDataFrame([(bytearray(x),) for x in (b"one", b"two", b"one", b"bad")], "content binary")
    got = sorted((r["result"] or "", r["error"] or "") for r in connectors.run(d, "test").collect())
    assert got == [("", "bad content"), ("one", ""), ("two", "")]
    assert sorted(r["result"] for r in connectors.run(d.where("content <> 'bad'"), "test").collect()) == ["one", "two"]


def test_slides_that_no_tool_draws_have_placeholders():
    made = json.loads(connectors.slide_images(bytes(deck({"title": "A", "notes": "", "shapes": []}, {"title": "B & C", "notes": "", "shapes": []}))))
    assert set(made) == {"1", "2"} and all("png" in x or "svg" in x for x in made.values())


def test_presentations_are_dealt_out_and_told_together(spark, sf, monkeypatch):
    """A small file of parts is many presentations, which all cores read; what is told at once does not change the rows."""
    d = catalogue.QUERIES["pptx_slides"](spark, sf)
    assert d.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    deck = intake.presentation([{"title": "T", "notes": "", "shapes": [("image", 1, b"x" * 60)]}, {"title": "U", "notes": "n", "shapes": [("text", 1, "t")]}])
    files = spark.createDataFrame([(k, deck if k % 5 else b"no") for k in range(50)], "k int, content binary").coalesce(1)
    batches = []
    for most, held in ((1, 1), (7, 1 << 20), (50, 100), (50, 1 << 20)):
        monkeypatch.setattr(connectors, "FILES", most)
        monkeypatch.setattr(connectors, "FILES_BYTES", held)
        batches.append(sorted(map(repr, connectors.slides(files, "content").collect())))
    assert len(batches[0]) == 90 and all(b == batches[0] for b in batches)

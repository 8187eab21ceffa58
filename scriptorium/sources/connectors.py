"""Tools outside Spark behind one form: a partition-wise function over rows with content.

A tool that is missing gives null and says so in `error`, and the rest of a plan goes on. Results are kept by
content digest, so a file is read by a tool once; `attempted` tells a kept null from a file not tried yet.
"""

from __future__ import annotations

import functools
import hashlib
import importlib
import json
import posixpath
import re
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from io import BytesIO
from xml.etree import ElementTree as ET

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from scriptorium.functions import formulas
from scriptorium.functions.latex import tabular
from scriptorium.functions.text import clean_answer
from scriptorium.operators.classify import OCR_ANY, OCR_LANGUAGE, notes_placeholder
from scriptorium.operators.merge import pick_denser
from scriptorium.operators.render import table_rows
from scriptorium.operators.sequence import block_text

Tool = Callable[[bytes], str | None]
BatchTool = Callable[[list[bytes]], list[str | None]]
OUT = "md5 string, result string, error string, attempted boolean"
_tools: dict[str, Tool] = {}
_batch_tools: dict[str, BatchTool] = {}


def register(name: str) -> Callable[[Tool], Tool]:
    def put(tool: Tool) -> Tool:
        _tools[name] = tool
        return tool

    return put


def register_batch(name: str) -> Callable[[BatchTool], BatchTool]:
    """A tool that takes all contents of a batch in one call; where the call fails, each content is tried alone."""

    def put(tool: BatchTool) -> BatchTool:
        _batch_tools[name] = tool
        _tools[name] = lambda content: tool([content])[0]
        return tool

    return put


def need(module: str):
    """A module, or a clear error."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise RuntimeError(f"{module} is not installed") from e


def run(files: DataFrame, name: str, kept: DataFrame | None = None) -> DataFrame:
    """md5, result, error, attempted of each distinct content; contents already in `kept` are not tried again."""
    tool, together = _tools[name], _batch_tools.get(name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, contents = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if together is not None:
                try:
                    rows = [(key, x, None, True) for key, x in zip(keys, together(contents), strict=True)]
                except Exception:  # noqa: BLE001  each is tried alone below
                    rows = []
            for key, content in zip(keys, contents, strict=True) if not rows else ():
                try:
                    rows.append((key, tool(content), None, True))
                except Exception as e:  # noqa: BLE001  any failure of an outside tool is a result here
                    rows.append((key, None, str(e)[:500], True))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["md5", "result", "error", "attempted"])

    d = files.select(F.md5("content").alias("md5"), "content").dropDuplicates(["md5"])
    if kept is None:
        return d.mapInArrow(work, OUT)
    return d.join(kept.select("md5"), "md5", "left_anti").mapInArrow(work, OUT).unionByName(kept)


def command(args: list[str], data: bytes | None = None, seconds: int = 600) -> bytes:
    """Output of a program, with a time limit that holds."""
    try:
        return subprocess.run(args, input=data, capture_output=True, timeout=seconds, check=True).stdout
    except FileNotFoundError as e:
        raise RuntimeError(f"{args[0]} is not installed") from e


@register("docx")
def docx_text(content: bytes) -> str:
    """Paragraphs and tables of a DOCX file in order: headings by level, table rows joined, ghosts of merged cells dropped."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            style = e.find(f"{w}pPr/{w}pStyle")
            level = (style.get(f"{w}val") or "") if style is not None else ""
            digits = "".join(c for c in level if c.isdigit())
            text = words(e).strip()
            if text:
                out.append(f"{'#' * int(digits or 1)} {text}" if level.lower().startswith(("heading", "titolo")) else text)
        elif e.tag == f"{w}tbl":
            rows, before = [], None
            for r in e.iter(f"{w}tr"):
                cells = [words(c).strip() for c in r.iter(f"{w}tc")]
                if cells != before:
                    rows.append(" | ".join(cells))
                before = cells
            out.append("[TABELLA]\n" + "\n".join(rows))
    return "\n".join(out)


A, P = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
COMPAT = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
#: Presentations that are told at once: so many, or so many bytes of pictures.
FILES, FILES_BYTES = 200, 4 << 20
#: A shape of a slide; lengths and places in the file's own units.
OBJECT = "struct<obj_type:string,content:string,top:bigint,left:bigint,width:bigint,height:bigint,rows:array<array<string>>,latex_result:string,image:binary>"


def _said(node: ET.Element) -> str:
    """The paragraphs of a shape that are not blank, by their runs."""
    rows = ("".join(t.text or "" for r in p.iter(f"{A}r") for t in r.iter(f"{A}t")) for p in node.iter(f"{A}p"))
    return "\n".join(x for x in rows if x.strip())


def _related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id to (kind, part) of a part of a package; the package's own are those of the part ""."""
    folder, _, name = part.rpartition("/")
    try:
        found = ET.fromstring(z.read(f"{folder}/_rels/{name}.rels".lstrip("/")))
    except KeyError:
        return {}
    full = lambda target: target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}").lstrip("/")
    return {r.get("Id"): ((r.get("Type") or "").rpartition("/")[2], full(r.get("Target") or "")) for r in found if r.get("TargetMode") != "External"}


def slide_parts(z: zipfile.ZipFile) -> list[str]:
    """The slides' parts as the presentation lists them; by number where the package has no presentation part."""
    names = set(z.namelist())
    main = next((part for kind, part in _related(z, "").values() if kind == "officeDocument"), "ppt/presentation.xml")
    if main not in names:
        return sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int("".join(c for c in n if c.isdigit())))
    related = _related(z, main)
    listed = [related.get(e.get(f"{R}id"), ("", ""))[1] for e in ET.fromstring(z.read(main)).iterfind(f"{P}sldIdLst/{P}sldId")]
    return [part for part in listed if part in names]


@dataclass(frozen=True)
class Place:
    """How lengths within a group become lengths on the slide, for one axis: start + scale * (x - origin)."""

    start: float = 0.0
    scale: float = 1.0
    origin: float = 0.0

    def of(self, x: float) -> float:
        return self.start + self.scale * (x - self.origin)

    def within(self, start: float, size: float, origin: float, extent: float) -> Place:
        """The axis of a group that stands here."""
        return Place(self.of(start), self.scale * (size / extent if extent else 1.0), origin)


def _pair(frame: ET.Element | None, name: str, first: str, second: str) -> tuple[float, float]:
    node = frame.find(f"{A}{name}") if frame is not None else None
    return (float(node.get(first) or 0), float(node.get(second) or 0)) if node is not None else (0.0, 0.0)


def _shapes(tree: ET.Element, x: Place = Place(), y: Place = Place()) -> Iterator[tuple[ET.Element, Place, Place]]:
    """Shapes in the order of the file, those of groups with the group's place; of alternative forms the first."""
    for node in tree:
        if node.tag == f"{P}grpSp":
            frame = node.find(f"{P}grpSpPr/{A}xfrm")
            (left, top), (width, height) = _pair(frame, "off", "x", "y"), _pair(frame, "ext", "cx", "cy")
            (from_x, from_y), (wide, high) = _pair(frame, "chOff", "x", "y"), _pair(frame, "chExt", "cx", "cy")
            yield from _shapes(node, x.within(left, width, from_x, wide), y.within(top, height, from_y, high))
        elif node.tag == f"{COMPAT}AlternateContent":
            choice = node.find(f"{COMPAT}Choice")
            yield from _shapes(choice if choice is not None else node.find(f"{COMPAT}Fallback") or (), x, y)
        elif node.tag in (f"{P}sp", f"{P}pic", f"{P}graphicFrame"):
            yield node, x, y


def _object(node: ET.Element, x: Place, y: Place, z: zipfile.ZipFile, related: dict) -> dict | None:
    """A shape as a formula, picture, table or text: what it is first of these."""
    frame = node.find(f"./{P}spPr/{A}xfrm")
    frame = node.find(f"./{P}xfrm") if frame is None else frame
    (left, top), (width, height) = _pair(frame, "off", "x", "y"), _pair(frame, "ext", "cx", "cy")
    at = {"top": round(y.of(top)), "left": round(x.of(left)), "width": round(width * x.scale), "height": round(height * y.scale)} if frame is not None else {"top": 0, "left": 0, "width": 0, "height": 0}
    out = {"obj_type": "text", "content": None, **at, "rows": None, "latex_result": None, "image": None}
    formula = node.find(f".//{{{formulas.MATH}}}oMath")
    table = node.find(f".//{A}tbl")
    if formula is not None:
        xml = ET.tostring(formula, encoding="unicode")
        return out | {"obj_type": "omml_formula", "content": xml, "latex_result": formula_latex(xml)}
    if node.tag == f"{P}pic":
        blip = node.find(f".//{A}blip")
        _, part = related.get(blip.get(f"{R}embed") if blip is not None else None, ("", ""))
        blob = z.read(part) if part in z.namelist() else None
        return out | {"obj_type": "image", "content": hashlib.md5(blob).hexdigest(), "image": blob} if blob is not None else None
    if table is not None:
        rows = [[_said(c).strip().replace("\n", " ") for c in r.iter(f"{A}tc")] for r in table.iter(f"{A}tr")]
        return out | {"obj_type": "table", "rows": rows} if rows else None
    text = _said(node)
    return out | {"content": text} if text else None


@functools.lru_cache(1 << 12)
def formula_latex(xml: str) -> str | None:
    return formulas.to_latex(xml)


def read_slides(content: bytes) -> list[dict]:
    """The slides of a PPTX file as it shows them: slide_number, title, objects (by height on the slide, ties as stored), notes."""
    out = []
    with zipfile.ZipFile(BytesIO(content)) as z:
        for number, name in enumerate(slide_parts(z), 1):
            related, title, objects, notes = _related(z, name), "", [], ""
            tree = ET.fromstring(z.read(name)).find(f"{P}cSld/{P}spTree")
            for node, x, y in _shapes(tree) if tree is not None else ():
                holder = node.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                if holder is not None and holder.get("type") in ("title", "ctrTitle") and not title:
                    title = _said(node)
                elif (found := _object(node, x, y, z, related)) is not None:
                    objects.append(found)
            for kind, part in related.values():
                if kind == "notesSlide" and part in z.namelist():
                    for s in ET.fromstring(z.read(part)).iter(f"{P}sp"):
                        holder = s.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                        if holder is not None and holder.get("type") == "body":
                            notes = _said(s).strip()
            out.append({"slide_number": number, "title": title, "objects": sorted(objects, key=lambda o: o["top"]), "notes": notes})
    return out


def slides(files: DataFrame, content: str) -> DataFrame:
    """The other columns of files, and slide_number, title, objects and notes of each slide of their PPTX content.

    Slides come in the presentation's order, and shapes of groups at their place on the slide. Formulas come with their
    LaTeX, tables as tabular, pictures named by the digest of their bytes (`pictures` has them once each); notes that
    are a template's prompt are empty. A content that is no PPTX file gives one row without a slide and with an error.
    Rows are read each by itself, repeated ones too, and nothing is shuffled.
    """
    rest = [c for c in files.columns if c != content]
    kind = f"array<struct<slide_number:int,title:string,objects:array<{OBJECT}>,notes:string>>"
    target = to_arrow_type(DataType.fromDDL(kind))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for k in range(batch.num_rows):
                content = batch.column(batch.num_columns - 1)[k]
                try:
                    got, error = read_slides(content.as_py()), None
                except Exception as e:  # noqa: BLE001  a file that cannot be read is a result here
                    got, error = None, str(e)[:500]
                found.append((got, error))
                held += sum(len(o["image"] or b"") for s in got or () for o in s["objects"])
                if held >= FILES_BYTES or len(found) >= FILES or k + 1 == batch.num_rows:
                    told, errors = zip(*found, strict=True)
                    rows = batch.slice(k + 1 - len(found), len(found)).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(told, target), pa.array(errors, pa.string())], names=[*rest, "_slides", "error"])
                    found, held = [], 0

    schema = StructType([files.schema[c] for c in rest]).add("_slides", DataType.fromDDL(kind)).add("error", "string")
    d = files.select(*rest, content).mapInArrow(work, schema).select(*rest, "error", F.explode_outer("_slides").alias("s")).select(*rest, "error", "s.*")
    shown = lambda o: F.when(o.obj_type == "table", tabular(o.rows)).otherwise(o.content)
    fields = ("top", "left", "width", "height", "latex_result", "image")
    one = lambda o, i: F.struct(i.alias("pos"), o.obj_type.alias("obj_type"), shown(o).alias("content"), *[o.getField(f).alias(f) for f in fields])
    d = d.withColumn("objects", F.transform(F.coalesce("objects", F.expr(f"cast(array() as array<{OBJECT}>)")), one))
    return d.withColumn("notes", F.when(notes_placeholder(F.col("notes")), "").otherwise(F.col("notes")))


def pictures(found: DataFrame) -> DataFrame:
    """md5, image of each distinct picture of `slides`."""
    each = found.select(F.explode("objects").alias("o")).where("o.obj_type = 'image'")
    return each.groupBy(F.col("o.content").alias("md5")).agg(F.any_value("o.image").alias("image"))


@register("pptx")
def pptx_text(content: bytes) -> str:
    """Slides of a PPTX file as marked text, shapes from top to bottom."""
    out = []
    for s in read_slides(content):
        shown = []
        for o in s["objects"]:
            if o["obj_type"] == "omml_formula":
                shown.append(f"[FORMULA: {o['latex_result'] or ''}]")
            elif o["obj_type"] == "table":
                shown.append("[TABELLA: " + "\n".join(" | ".join(r) for r in o["rows"]) + "]")
            elif o["obj_type"] == "text":
                shown.append(o["content"])
        out.append("\n".join([f"--- SLIDE {s['slide_number']}" + (f": {s['title']}" if s["title"] else "") + " ---", *shown]))
    return "\n\n".join(out)


@register("pdf")
def pdf_text(content: bytes) -> str:
    reader = need("PyPDF2").PdfReader(BytesIO(content))
    return "\n\n".join(f"--- PAG {i} ---\n{p.extract_text() or ''}" for i, p in enumerate(reader.pages, 1))


@register("pdf_layout")
def pdf_layout(content: bytes) -> str:
    """A JSON array of pages, each with its text and its tables as rows of cells."""
    with need("pdfplumber").open(BytesIO(content)) as pdf:
        return json.dumps([{"page": i, "text": (p.extract_text(x_tolerance=3, y_tolerance=3) or "").strip(), "tables": [t for t in p.extract_tables() if t]} for i, p in enumerate(pdf.pages, 1)])


@register("pdf_blocks")
def pdf_blocks(content: bytes) -> str:
    """A JSON array of the blocks of text of all pages, with their places."""
    pages = need("fitz").open(stream=content, filetype="pdf")
    return json.dumps([{"page": i, "x0": b[0], "y0": b[1], "y1": b[3], "text": b[4].strip()} for i, p in enumerate(pages, 1) for b in p.get_text("blocks") if b[6] == 0 and b[4].strip()])


def pdf_pages(layout: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, page, text, chars_count from the results of both readers (key, result): the denser text of each page.

    The first reader's text has its tables below it; where one reader is missing the other decides alone.
    """
    pages = layout.select(key, F.explode(F.from_json("result", "array<struct<page:int,text:string,tables:array<array<array<string>>>>>")).alias("p"))
    tables = F.filter(F.transform("p.tables", table_rows), lambda t: t != "")
    marked = F.transform(tables, lambda t: F.concat(F.lit("[TABELLA]\n"), t))
    one = pages.select(key, F.col("p.page").alias("page"), F.array_join(F.filter(F.concat(F.array("p.text"), marked), lambda x: x != ""), "\n").alias("text")).where("text <> ''")
    rows = blocks.select(key, F.explode(F.from_json("result", "array<struct<page:int,x0:double,y0:double,y1:double,text:string>>")).alias("b")).select(F.struct(key, F.col("b.page").alias("page")).alias("at"), "b.*")
    two = block_text(rows.drop("page"), "at").select(F.col(f"at.{key}").alias(key), F.col("at.page").alias("page"), "text")
    return pick_denser(one, two, [key, "page"], "text")


@register("speech")
def transcript(content: bytes) -> str:
    """Lines `[MM:SS] text` of a recording."""
    model = need("whisper").load_model("base")
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(content)
        f.flush()
        found = model.transcribe(f.name)
    return "\n".join(f"[{int(s['start']) // 60:02d}:{int(s['start']) % 60:02d}] {s['text'].strip()}" for s in found["segments"])


@register("video_audio")
def video_audio(content: bytes) -> str:
    """A recording's sound as mono MP3, in base 64."""
    import base64

    return base64.b64encode(command(["ffmpeg", "-i", "pipe:0", "-vn", "-ac", "1", "-f", "mp3", "pipe:1"], content)).decode()


@register("duration")
def duration(content: bytes) -> str:
    try:
        return command(["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", "pipe:0"], content, 10).decode().strip()
    except (RuntimeError, subprocess.SubprocessError):
        return "0"


def page_ocr(content: bytes, lang: str = OCR_ANY) -> str:
    image = need("PIL.Image").open(BytesIO(content))
    return need("pytesseract").image_to_string(image, lang=lang).strip()


register("page_ocr")(page_ocr)
for _lang in OCR_LANGUAGE.values():
    register(f"page_ocr_{_lang}")(functools.partial(page_ocr, lang=_lang))


def binarised(gray: np.ndarray, border: int = 10) -> np.ndarray:
    """A picture in shades of grey as black on white with a white border: black is half a standard deviation below the mean."""
    white = gray.astype(float) > gray.mean() - gray.std() * 0.5
    return np.pad(np.where(white, 255, 0).astype(np.uint8), border, constant_values=255)


@register("formula_text")
def formula_text(content: bytes) -> str:
    """A formula's picture read as text, enlarged where it is small, in black and white."""
    image = need("PIL.Image").open(BytesIO(content)).convert("L")
    if image.width < 300:
        times = max(2, 300 // image.width)
        image = image.resize((image.width * times, image.height * times))
    return need("pytesseract").image_to_string(need("PIL.Image").fromarray(binarised(np.asarray(image))), lang="eng", config="--psm 6").strip()


#: The longest side of an image that is sent on.
LONGEST = 1920


def fitted(width: Column, height: Column, most: int = LONGEST) -> Column:
    """The size that an image is scaled to, its longer side at most `most`: a struct of width and height."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


@register("image_fitted")
def image_fitted(content: bytes) -> str:
    """A picture scaled down, as PNG in base 64; a smaller one is only converted."""
    import base64

    image = need("PIL.Image").open(BytesIO(content))
    scale = min(1.0, LONGEST / max(image.size))
    out = BytesIO()
    image.resize((int(image.width * scale), int(image.height * scale))).save(out, "PNG")
    return base64.b64encode(out.getvalue()).decode()


@register("pixel_stats")
def pixel_stats(content: bytes) -> str:
    """width,height,light,dark,saturation for `is_formula_image`."""
    import numpy as np

    image = need("PIL.Image").open(BytesIO(content)).convert("RGB")
    x, small = np.asarray(image), np.asarray(image.resize((64, 64))).astype(float)
    top = small.max(axis=2)
    sat = np.where(top > 0, (top - small.min(axis=2)) / np.maximum(top, 1), 0).mean()
    return f"{image.width},{image.height},{(x > 200).all(axis=2).mean()},{(small < 100).all(axis=2).mean()},{sat}"


def download(url: str, attempts: int = 3, seconds: int = 7200) -> bytes:
    """A recording by address; a time-out is not tried again."""
    for k in range(attempts):
        try:
            return command(["ffmpeg", "-i", url, "-c", "copy", "-f", "matroska", "pipe:1"], None, seconds)
        except subprocess.TimeoutExpired:
            raise
        except subprocess.SubprocessError:
            if k == attempts - 1:
                raise
    raise RuntimeError("no attempt was made")


@register("slide_raster")
def slide_raster(content: bytes) -> str:
    """Slides of a presentation as a PDF, in base 64 (files of an outside tool, gone when it ends)."""
    import base64
    import pathlib
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        path = pathlib.Path(d, "slides.pptx")
        path.write_bytes(content)
        command(["soffice", "--headless", "--convert-to", "pdf", "--outdir", d, str(path)], None, 120)
        return base64.b64encode(path.with_suffix(".pdf").read_bytes()).decode()


@register("page_raster")
def page_raster(content: bytes, wanted: frozenset[int] | None = None) -> str:
    """Pages of a PDF (all, or those of some numbers) as PNG at 200 dots an inch: a JSON object of base 64 by number."""
    import base64

    pages = need("fitz").open(stream=content, filetype="pdf")
    return json.dumps({i: base64.b64encode(p.get_pixmap(dpi=200).tobytes("png")).decode() for i, p in enumerate(pages, 1) if wanted is None or i in wanted})


def placeholder_slide(number: int, title: str, width: int = 1920, height: int = 1080) -> str:
    """What stands for a slide that no tool could draw: its number and title as SVG."""
    from xml.sax.saxutils import escape

    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><rect width="100%" height="100%" fill="white" stroke="black"/><text x="50%" y="50%" text-anchor="middle" font-size="64">{number}. {escape(title)}</text></svg>'


@register("slide_images")
def slide_images(content: bytes) -> str:
    """A JSON object of each slide's picture by number: PNG in base 64, or SVG placeholders where no tool can draw slides."""
    import base64

    try:
        drawn = json.loads(page_raster(base64.b64decode(slide_raster(content))))
    except (RuntimeError, subprocess.SubprocessError):
        drawn = {}
    return json.dumps({s["slide_number"]: {"png": drawn[n]} if (n := str(s["slide_number"])) in drawn else {"svg": placeholder_slide(s["slide_number"], s["title"])} for s in read_slides(content)})


def fetched(urls: DataFrame, url: str, get: Callable[[str], bytes] | None = None) -> DataFrame:
    """url, content, error of each distinct address; nothing is fetched twice within a run."""
    get = get or download

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                try:
                    row = (get(address), None)
                except Exception as e:  # noqa: BLE001  an address that cannot be read is a result here
                    row = (None, str(e)[:500])
                yield pa.RecordBatch.from_arrays([pa.array([address]), pa.array([row[0]], pa.binary()), pa.array([row[1]], pa.string())], names=["url", "content", "error"])

    return urls.select(F.col(url).alias("url")).where("url is not null").distinct().mapInArrow(work, "url string, content binary, error string")


@register_batch("formula_ocr")
def formula_ocr(contents: list[bytes]) -> list[str | None]:
    """Pictures of formulas as LaTeX; the model is loaded once for each worker and takes a batch at a time."""
    if "model" not in _loaded:
        _loaded["model"] = need("pix2tex.cli").LatexOCR()
    pictures = [need("PIL.Image").open(BytesIO(c)) for c in contents]
    return [(_loaded["model"](p) or "").strip() or None for p in pictures]


_loaded: dict = {}


def answers(rows: DataFrame, prompt: str, skeleton: str, call: Callable[[str], str] | None = None, attempts: int = 3, wait: float = 20.0) -> DataFrame:
    """Adds answer and error: a model's cleaned answer to each prompt, or the skeleton where there is no model or it fails.

    An error that names 429 or 529 is tried again after wait x attempt seconds.
    """
    if call is None:
        return rows.withColumns({"answer": F.col(skeleton), "error": F.lit(None).cast("string")})

    @F.pandas_udf("answer string, error string")
    def ask(prompts):
        import time

        import pandas as pd

        out = []
        for p in prompts:
            for k in range(1, attempts + 1):
                try:
                    out.append((call(p), None))
                    break
                except Exception as e:  # noqa: BLE001  a remote failure is a result here
                    if k == attempts or not any(code in str(e) for code in ("429", "529")):
                        out.append((None, str(e)[:500]))
                        break
                    time.sleep(wait * k)
        return pd.DataFrame(out, columns=["answer", "error"])

    d = rows.withColumn("_a", ask(F.col(prompt)))
    return d.withColumns({"answer": F.coalesce(clean_answer(F.col("_a.answer")), F.col(skeleton)), "error": F.col("_a.error")}).drop("_a")

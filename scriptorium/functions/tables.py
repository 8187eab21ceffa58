"""Row-producing operators as table functions of SQL, on Arrow batches of one text each.

    register(spark)
    spark.sql("select * from parse_transcript(table(select doc_id, text from documents) partition by doc_id)")

Each takes a table of (key, text) and gives the key, as a string, with the rows of its texts. A partition is all rows of a key;
texts of a key are told apart by nothing but their order of arrival, so keys should be unique.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

#: Must-match patterns of stamps, markers and headings.
STAMP = re.compile(r"^\[(\d{1,2}:\d{2}(?::\d{2})?)\]\s*(.+)$", re.M)
MARKER = re.compile(r"^---\s*(?:SLIDE|slide)\s*(\d+)(?:\s*:\s*(.+?))?\s*---\s*$", re.M)
MARK = re.compile(r"^---\s*(?:SLIDE|PAG)\s*(\d+)\s*---\s*$", re.I)
CAPITALS = re.compile(r"^[A-Z][A-Z\s\-:]{8,}$")
SPOKEN = re.compile(r"^\[\d{2}:\d{2}\](.*)$")
LETTERS = re.compile(r"[^\W\d_]+")


def seconds(stamp: str) -> int:
    total = 0
    for part in stamp.split(":"):
        total = total * 60 + int(part)
    return total


def transcript_rows(text: str) -> Iterator[tuple]:
    for seq, m in enumerate(STAMP.finditer(text)):
        yield seq, seconds(m[1]), m[2].strip()


def slide_rows(text: str) -> Iterator[tuple]:
    marks = list(MARKER.finditer(text))
    for pos, m in enumerate(marks):
        end = marks[pos + 1].start() if pos + 1 < len(marks) else len(text)
        yield pos, int(m[1]), (m[2] or "").strip(), text[m.end() : end].strip()


def section_rows(text: str) -> Iterator[tuple]:
    sid, heading, body = 0, None, []

    def section() -> Iterator[tuple]:
        whole = "\n".join(body).strip()
        if heading is not None or whole:
            yield sid, heading, whole

    for line in text.split("\n"):
        t = line.strip()
        if said := SPOKEN.match(t):
            line = said[1].strip()
            if not line:
                continue
            body.append(line)
        elif (mark := MARK.match(t)) or CAPITALS.match(t) and len(t) > 10:
            yield from section()
            sid, body = sid + 1, []
            heading = f"Slide / Pagina {mark[1]}" if mark else LETTERS.sub(lambda w: w[0].capitalize(), t)
        else:
            body.append(line)
    yield from section()


def _function(rows, schema: str):
    """A table function that reads (key, text) and gives key and rows."""
    kinds = {"string": pa.string(), "int": pa.int32()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)

    class Reader:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            out = [(str(key), *row) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if key is not None and text for row in rows(text)]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.table({n: pa.array(c, kinds[t]) for n, t, c in zip(names, types, columns, strict=True)})

    return arrow_udtf(Reader, returnType=schema)


FUNCTIONS = {
    "parse_transcript": (transcript_rows, "key string, seq int, time_sec int, text string"),
    "parse_slides": (slide_rows, "key string, slide_pos int, slide_num int, title string, body string"),
    "parse_sections": (section_rows, "key string, sid int, heading string, body string"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (rows, schema) in FUNCTIONS.items():
        spark.udtf.register(name, _function(rows, schema))
    return list(FUNCTIONS)

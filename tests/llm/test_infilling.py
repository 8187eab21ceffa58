"""Fill-in-middle against a plain version, with texts that hold delimiter, escapes and markers."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import infilling

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def odd_texts(seed):
    rng = random.Random(seed)
    signs = ["\x1f", "\x1e", "\x1e0", "\x1e1", "0", "1", " ", "\t", "\n", "\x0b", "\xa0", " ", "a", "é", "😀", "<", "P", "<P", "S>", "M", ">", "$0", "\\"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    return texts + [None, "", " ", "\n\n", "x", " x ", "<P>", "a <S> b", "<M", "<<P>", "\x1f" * 50, "w " * 200_000, "z" * 300_000, " " * 100_000]


@pytest.mark.parametrize("rate", [50, 100])
def test_against_a_plain_version(spark, rate):
    rows = [(k, t) for k, t in enumerate(odd_texts(rate))] + [(None, "no number here"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int")
    out = infilling.infilled(docs, rate=rate)
    got = [tuple(r) for r in out.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=order) == sorted((brute(i, t, rate) for i, t in rows), key=order)
    back = out.select("doc_id", infilling.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=order) == sorted(((i, t or "") for i, t in rows), key=order)
    assert {"plain", "spm", "psm"} <= {r[2] for r in got}


def test_digests_and_lengths(spark):
    rows = list(enumerate(odd_texts(3)))
    got = {r.doc_id: r for r in infilling.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        _, n, form, p, m, _, output = brute(i, t)
        assert tuple(got[i])[1:] == (n, form, None if p is None else len(p), None if m is None else len(m), sha(output), sha(t or ""))


def test_other_markers(spark):
    markers = infilling.Markers("[PRE]", "[SUF]", "[MID]")
    docs = spark.createDataFrame([(k, f"some words <P> of text {k}") for k in range(40)], "doc_id long, text string")
    out = infilling.infilled(docs, rate=100, markers=markers)
    back = out.select("output", infilling.restored(F.col("output"), F.col("form"), markers).alias("text"), "doc_id").collect()
    assert all(r.text == f"some words <P> of text {r.doc_id}" and r.output.count("[MID]") == 1 for r in back)


def test_an_empty_table(spark):
    assert infilling.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_projection_without_shuffle(spark, sf):
    plan = infilling.fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_replace") == 1

"""Joins along time, profiles, stored states, table functions and lesson folders, against plain versions."""

import random
import re
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import tables
from scriptorium.operators import pictures, profiles, sequence, timeline
from scriptorium.plans import catalogue
from scriptorium.session import new_dir
from scriptorium.sources import connectors, lessons, states
from scriptorium.streaming import stateful

DAY = datetime(2024, 1, 1)


def moments(seed, n, hot):
    """Rows (key, time, number); half of them have one key, some no key or time, some are at one moment."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        key = 1 if rng.random() < hot else rng.choice([None, 2, 3, 4])
        out.append((key, None if rng.random() < 0.03 else DAY + timedelta(minutes=rng.randrange(4000)), k))
    return out


@pytest.mark.parametrize("width, tolerance", [(600, None), (86_400 * 9, None), (3600, 1800)])
def test_as_of(spark, width, tolerance):
    left, right = moments(1, 300, 0.5), moments(2, 200, 0.5)
    asked = spark.createDataFrame([*left, left[0], left[0]], "k int, t timestamp, n int")
    given = spark.createDataFrame([(*r, f"v{r[2]}") for r in right], "k int, t timestamp, m int, v string")
    got = sorted(((r["n"], r["v"]) for r in timeline.as_of(asked, given, "k", "t", "m", ["v"], tolerance, width).collect()), key=repr)
    want = []
    for k, t, n in [*left, left[0], left[0]]:
        before = [(u, m) for j, u, m in right if k is not None and t is not None and j == k and u is not None and u <= t and (tolerance is None or t - u <= timedelta(seconds=tolerance))]
        want.append((n, f"v{max(before)[1]}" if before else None))
    assert got == sorted(want, key=repr)
    none = timeline.as_of(asked, given.where("k = 99"), "k", "t", "m", ["v"]).collect()
    assert len(none) == 302 and {r["v"] for r in none} == {None}


@pytest.mark.parametrize("width", [300, 86_400])
def test_within(spark, width):
    left, rng = moments(3, 200, 0.5), random.Random(4)
    right = [(k, t, None if t is None else t + timedelta(minutes=rng.choice([-5, 0, 1, 30, 700])), n) for k, t, n in moments(5, 60, 0.5)]
    got = timeline.within(spark.createDataFrame(left, "k int, t timestamp, n int"), spark.createDataFrame(right, "k int, a timestamp, b timestamp, m int"), "k", "t", "a", "b", width)
    want = sorted((n, m) for k, t, n in left for j, a, b, m in right if k is not None and k == j and t is not None and a is not None and a <= t < b)
    assert want and sorted((r["n"], r["m"]) for r in got.collect()) == want


@pytest.mark.parametrize("shard", [profiles.SHARD, 9000])
def test_ten_thousand_keywords(spark, sf, shard):
    """Equal to looking for each keyword in each text."""
    rng = random.Random(6)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()][:80] + [None, "", "abc"]
    words = sorted({w for t in texts if t for w in re.findall(r"\w{3,}", t)})
    known = [(f"p{rng.randrange(40)}", rng.randrange(100), w.upper() if k % 7 == 0 else w) for k, w in enumerate(words)]
    known += [(f"p{rng.randrange(40)}", rng.randrange(100), "".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 6)))) for _ in range(10_000 - len(known))]
    known += [("p1", 5, None), ("p1", 5, ""), (None, 1, "abc")]
    docs = spark.createDataFrame([(k, t, "score") for k, t in enumerate(texts)], "k int, text string, score string")
    got = {r["k"]: (r["subject"], r["score"]) for r in profiles.subjects(docs, "text", spark.createDataFrame(known, "profile string, rank int, keyword string"), shard=shard).collect()}
    ranks, by = {}, {}
    for p, r, w in known:
        if p is not None and w:
            ranks[p] = min(ranks.get(p, r), r)
            by.setdefault(p, set()).add(w.lower())
    for k, t in enumerate(texts):
        best = max(((sum(w in t.lower() for w in ws), -ranks[p], p) for p, ws in by.items()), default=(0, 0, "")) if t else (0, 0, "")
        assert got[k] == (best[2] if best[0] >= 2 else "generico", best[0])


def test_hints_name_profiles(spark):
    known = spark.createDataFrame([("fisica", 1, "onda"), ("Fisica Teorica", 0, "campo"), ("chimica", 2, "acido"), ("chimica", 2, "base")], "profile string, rank int, keyword string")
    docs = spark.createDataFrame([(1, "acido e base", "corso di FISICA"), (2, "acido e base", ""), (3, "acido e base", None), (4, "niente", "teorica"), (5, "niente", "altro")], "k int, t string, hint string")
    got = {r["k"]: r["subject"] for r in profiles.subjects(docs, "t", known, hint="hint").collect()}
    assert got == {1: "fisica", 2: "chimica", 3: "chimica", 4: "Fisica Teorica", 5: "generico"}
    nobody = profiles.subjects(docs, "t", known.where("rank > 9"), hint="hint").collect()
    assert {r["subject"] for r in nobody} == {"generico"} and {r["score"] for r in nobody} == {0}


def test_states_of_all_ages(spark):
    rows = [
        (1, "a=1\r\nb = x=y \n=nameless\nplain\na=2\nc=007\nd=\"q\\"),
        (2, '{"lessons":[{"number":4,"title":"t"},{"number":2}],"course_title":"C","unknown":[1,{"x":2}]}'),
        (3, '{"next_run":5,"next_lesson":"9","runs":[{"run":1,"lessons":[1,2]}],"subject":null}'),
        (4, "{ broken"), (5, ""), (6, None), (7, '{"status":"running","stderr":"e","created_at":"2024-05-06 07:08:09"}'), (8, '{"status":"done","stdout":"out"}'),
    ]
    d = spark.createDataFrame(rows, "k int, text string").withColumn("s", states.as_state(F.col("text")))
    got = {r["k"]: r["r"] for r in d.select("k", states.read_run(F.col("s")).alias("r")).collect()}
    assert [got[k]["version"] for k in range(1, 7)] == [0, 1, 2, None, None, None]
    assert (got[2]["course_title"], got[2]["next_lesson"], got[2]["next_run"], [tuple(x) for x in got[2]["lessons"]]) == ("C", 5, 1, [(4, "t"), (2, None)])
    assert (got[3]["next_run"], got[3]["next_lesson"], got[3]["subject"], got[3]["runs"][0]["lessons"]) == (5, 9, "generico", [1, 2])
    assert got[6]["next_lesson"] == 1 and got[4]["lessons"] == []
    field = lambda name, kind: {r["k"]: r["x"] for r in d.select("k", states.field(F.col("s"), name, kind).alias("x")).collect()}
    assert (field("a", "int")[1], field("b", "string")[1], field("c", "string")[1], field("d", "string")[1]) == (2, "x=y", "007", '"q\\')
    job = {r["k"]: r["j"] for r in d.select("k", states.read_job(F.col("s")).alias("j")).collect()}
    assert (job[7]["status"], job[7]["stderr"], job[7]["created_at"]) == ("error", "interrupted", datetime(2024, 5, 6, 7, 8, 9)) and (job[8]["status"], job[8]["stdout"]) == ("done", "out")
    path = new_dir(spark, "states")
    d.select("k", "s").write.parquet(path)  # old and new forms lie in one stored column
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).select("k", states.version_of(F.col("s")).alias("v")).collect()}[2] == 1


def test_table_functions(spark):
    text = "[00:05] uno \n[1:02:03]  due\nno\n--- SLIDE 1: A ---\nbody\n[00:07] said\n[00:08]\n--- slide 2 ---\n\nPARTE PRIMA ALFA\nlast line "
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", "plain"), (None, text)], "k string, text string")
    assert tables.register(spark) == list(tables.FUNCTIONS)
    run = lambda name: sorted(tuple(r) for r in spark.sql(f"select * from {name}(table(select k, text from {{d}}) partition by k)", d=docs).collect())
    keyed = docs.where("k is not null")
    native = lambda df, *columns: sorted(tuple(r) for r in df.select(*columns).collect())
    assert run("parse_transcript") == native(sequence.parse_transcript(keyed, "k", F.col("text")), "k", "seq", "time_sec", "text")
    assert run("parse_slides") == native(sequence.parse_slides(keyed, "k", F.col("text")), "k", "slide_pos", "slide_num", "title", "body")
    lines = sequence.explode_lines(keyed, "k", "text")
    want = native(sequence.parse_sections(lines, "k", "pos", "line"), "k", F.col("sid").cast("int"), "heading", "body")
    assert sorted(run("parse_sections"), key=repr) == sorted(want, key=repr)


def test_lesson_folders(spark, tmp_path):
    spark.dataSource.register(lessons.LessonFolders)
    root = tmp_path / "course"
    put = lambda folder, name, content=b"x": ((root / folder).mkdir(parents=True, exist_ok=True), (root / folder / name).write_bytes(content))
    for k in range(40):
        put(f"l{k:02d}", "Notes.TXT", b"note %d" % k)
    for name in ("b.pptx", "A.pdf", ".hidden.txt", "__x.txt", "Thumbs.db", "what.xyz", "noext"):
        put("l00", name)
    put(".git", "a.txt")
    (root / "loose.txt").write_text("no lesson")
    got = sorted((r["lesson"], r["name"], r["kind"], r["size"]) for r in spark.read.format("lessons").load(str(root)).collect())
    assert got[:3] == [("l00", "A.pdf", "pdf", 1), ("l00", "Notes.TXT", "text", 6), ("l00", "b.pptx", "slide", 1)] and len(got) == 42
    log, seen = new_dir(spark, "log"), []
    run = lambda: stateful.drain(spark.readStream.format("lessons").load(str(root)), log, write=lambda rows, n: seen.append(sorted({r["lesson"] for r in rows.collect()})))
    run()
    put("zz", "new.txt")
    put("a0", "new.txt")
    run()
    run()  # nothing new
    assert [x for x in seen if x] == [[f"l{k:02d}" for k in range(40)], ["a0", "zz"]]


def test_offsets_of_one_moment(tmp_path, monkeypatch):
    """Folders of the moment that an offset names are told by name, whichever are listed later."""
    stream = lessons.LessonStream(str(tmp_path))
    at = [(5, "b"), (5, "a"), (7, "c")]
    monkeypatch.setattr(lessons, "folders", lambda root: sorted(at))
    first = stream.latestOffset()
    assert [p for part in stream.partitions(stream.initialOffset(), first) for p in part.paths] == ["a", "b", "c"]
    at.append((7, "d"))
    second = stream.latestOffset()
    assert [p for part in stream.partitions(first, second) for p in part.paths] == ["d"]
    assert [p for part in stream.partitions(stream.initialOffset(), first) for p in part.paths] == ["a", "b", "c"]  # the first batch, given again
    assert stream.partitions(second, stream.latestOffset()) == []
    monkeypatch.setattr(lessons, "folders", lambda root: [])
    assert stream.latestOffset() == stream.initialOffset()


def test_pictures_as_rows_of_pixels(spark):
    """The rows of pixels give what the array gives."""
    rng = np.random.default_rng(2)
    shades = {k: rng.integers(0, 256, (3 + k, 5 + 2 * k)) for k in range(4)} | {9: np.full((1, 1), 7)}
    rows = [(k, x, y, int(a[y, x])) for k, a in shades.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    black = pictures.binarised(spark.createDataFrame(rows, "k int, x long, y long, v int").repartition(3), "k", "v", "b")
    out = pictures.framed(black.select("k", "x", "y", F.col("b").alias("v")), "k", "x", "y", "v").collect()
    for k, a in shades.items():
        want = connectors.binarised(a)
        got = np.full(want.shape, -1)
        for r in out:
            if r["k"] == k:
                got[r["y"], r["x"]] = r["v"]
        assert (got == want).all() and sum(r["k"] == k for r in out) == want.size
    nothing = pictures.binarised(spark.createDataFrame([(None, 1, 1, 5), (2, 0, 0, None)], "k int, x long, y long, v int"), "k", "v", "b").collect()
    assert sorted(((r["k"], r["b"]) for r in nothing), key=repr) == [(2, None), (None, 0)]


def test_pixels_at_the_threshold(spark):
    """Four equal pixels and a lighter one have the former as threshold, exactly; no order of rows makes them white."""
    rows = [(f"{x} {y} {at}", y if k == at else x, k == at) for x in range(1, 250, 12) for y in range(x + 1, 256, 7) for at in range(5) for k in range(5)]
    d = spark.createDataFrame(rows, "k string, v int, lighter boolean").coalesce(1)
    out = pictures.binarised(d, "k", "v", "b")
    assert out.columns == ["k", "v", "lighter", "b"] and out.count() == len(rows)
    assert out.where((F.col("b") == 255) != F.col("lighter")).collect() == []
    shades = spark.createDataFrame([(1, 0.25), (1, 0.5), (1, None)], "k int, v double")
    assert sorted(((r["v"], r["b"]) for r in pictures.binarised(shades, "k", "v", "b").collect()), key=repr) == [(0.25, 0), (0.5, 255), (None, None)]


def test_pixel_query_without_quantity_or_order(spark, tmp_path):
    """As in the SQL: a pixel without a quantity is black, and what has no order is white."""
    rows = [(1, 1, 1, 1, 10.0), (1, 1, 1, 2, None), (1, 1, 1, 3, 40.0), (None, 1, 1, 1, 9.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalogue.QUERIES["pixel_threshold"](spark, str(tmp_path)).select("l_orderkey", "x", "y", "v").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(duck.execute(catalogue.ORACLE_SQL["pixel_threshold"]).fetchall(), key=repr)


def test_pixel_query_at_the_threshold(spark, tmp_path):
    """Where the threshold is a pixel's own value the SQL's rounding decides, in the order of places; rows are dealt at random here."""
    rows = [(1000 * x + 5 * y + at, k, k, 1, float(y if k == at else x)) for x in range(1, 50, 3) for y in range(x + 1, 51) for at in range(5) for k in range(5)]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").repartition(7).write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = set(duck.execute(f"select l_orderkey, x, v from ({catalogue.ORACLE_SQL['pixel_threshold']}) where y = 2").fetchall())
    got = catalogue.QUERIES["pixel_threshold"](spark, str(tmp_path)).where("y = 2").select("l_orderkey", "x", "v").collect()
    assert set(map(tuple, got)) == want

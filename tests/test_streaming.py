import json
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import context, jobs
from scriptorium.session import new_dir
from scriptorium.streaming import stateful, streams
from scriptorium.streaming.tables import KeyedTable, last_of


def test_late_files_continue(spark, sf, tmp_path):
    """A second run of the same query reads only what is new."""
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    src, log = (str(tmp_path / x) for x in ("in", "log"))
    table = KeyedTable(spark, str(tmp_path / "out"), events.schema, "user_id", buckets=4)
    parts = events.withColumn("p", F.col("event_id") % 2)
    parts.where("p = 0").drop("p").coalesce(1).write.parquet(src)
    run = lambda: stateful.drain(streams.source(spark, src, events.schema), log, write=lambda rows, n: table.merge(rows, n, last_of("user_id", ["ts", "event_id"])))
    run()
    parts.where("p = 1").drop("p").coalesce(1).write.mode("append").parquet(src)
    assert run().lastProgress["numInputRows"] == parts.where("p = 1").count()
    got = {r["user_id"]: r["event_id"] for r in table.read().collect()}
    want = {r["user_id"]: r["e"] for r in events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want


def data_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_a_merge_writes_the_touched_buckets_only(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    table = KeyedTable(spark, str(tmp_path), rows.schema, "k", buckets=16)
    keep = last_of("k", ["v"])
    assert table.read().count() == 0
    table.merge(rows, 0, keep)
    before = data_files(tmp_path)
    assert len(before) == 16
    one = spark.createDataFrame([(7, 5), (7, 3), (10**9, 1)], rows.schema)
    table.merge(one, 1, keep)
    new = data_files(tmp_path) - before
    assert 1 <= len(new) <= 2 and sum(map(os.path.getsize, new)) < sum(map(os.path.getsize, before)) / 4
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 4001 and got[7] == 5 and got[10**9] == 1
    table.merge(spark.createDataFrame([(7, 99)], rows.schema), 1, keep)  # the same batch again, after a failure
    assert {r["v"] for r in table.read().where("k = 7").collect()} == {5}


def test_old_data_goes_and_keys_may_go(spark, tmp_path):
    schema = "k long, v int"
    table = KeyedTable(spark, str(tmp_path), stateful.schema_of(schema), "k", buckets=2)
    keep = last_of("k", ["v"])
    for n in range(6):
        table.merge(spark.createDataFrame([(k, n) for k in range(20)], schema), n, keep)
    assert table.batches() == [4, 5] and {f.split("/data/")[1].split("/")[0] for f in data_files(tmp_path)} == {"4", "5"}
    table.merge(spark.createDataFrame([(k, 9) for k in range(20)], schema), 6, lambda rows: rows.where("k > 100"))
    assert table.read().count() == 0 and table.manifest() == {}
    table.merge(spark.createDataFrame([], schema), 7, keep)
    table.merge(spark.createDataFrame([(None, 1)], schema), 8, keep)
    assert [tuple(r) for r in table.read().collect()] == [(None, 1)]


def test_a_batch_that_was_not_committed_is_not_read(spark, tmp_path):
    schema = "k long, v int"
    table = KeyedTable(spark, str(tmp_path), stateful.schema_of(schema), "k", buckets=2)
    keep = last_of("k", ["v"])
    table.merge(spark.createDataFrame([(1, 1)], schema), 0, keep)
    spark.createDataFrame([(1, 8, 0), (1, 8, 1)], f"{schema}, bucket int").write.partitionBy("bucket").parquet(f"{tmp_path}/data/1")  # a writer that was lost before its commit
    (tmp_path / "manifest" / ".000000001.draft").write_text(json.dumps({"0": 1}))
    assert [tuple(r) for r in table.read().collect()] == [(1, 1)]
    table.merge(spark.createDataFrame([(1, 2)], schema), 1, keep)
    assert [tuple(r) for r in table.read().collect()] == [(1, 2)]


def test_windows_as_stream(spark, sf):
    """Closed days of the streaming form are those of the batch form."""
    events = streams.source(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out, log = new_dir(spark, "days"), new_dir(spark, "days-log")
    stateful.drain(streams.daily(events), log, path=out)
    batch = {(r["window"], r["event_type"]): r["n"] for r in streams.daily(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    got = {(r["window"], r["event_type"]): r["n"] for r in spark.read.parquet(out).collect()}
    assert got and all(batch[k] == n for k, n in got.items()) and len(got) >= len(batch) - 15


START = 1_000_000


def at(spark, rows, schema):
    """Rows whose `t` (seconds after START, as a watermark begins at zero) becomes a time."""
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("t") + START)).drop("t")


def arrive(spark, parts, schema, run):
    """Parts that arrive one after the other, told apart by their number."""
    rows = at(spark, [(k, *r) for k, part in enumerate(parts) for r in part], f"part int, {schema}")
    return stateful.replay(spark, rows, [F.col("part") == k for k in range(len(parts))], run)


HOUR = 3600


def test_late_rows_of_sessions(spark):
    """Rows out of order join and bridge sessions while these are open; later ones are dropped and counted."""
    out = new_dir(spark, "sessions")
    parts = [
        [("a", 0, 1), ("a", 2 * HOUR, 2), ("b", 0, 3), ("a", 11 * HOUR, 4)],
        [("a", 1 * HOUR, 5), ("b", 30 * HOUR, 6)],  # bridges the first two, which are open: the watermark is at one hour
        [("b", 1 * HOUR, 7), ("c", 50 * HOUR, 8)],  # late: the watermark is at twenty hours
        [("c", 200 * HOUR, 9)],
    ]
    queries = arrive(spark, parts, "k string, t long, seq long", lambda rows, log: stateful.drain(streams.sessions(rows, "k", "90 minutes", "10 hours"), log, path=out))
    got = sorted((r["k"], r["first"], r["last"], r["n"], (r["end"] - r["start"]).total_seconds()) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, 5, 3, 3.5 * HOUR), ("a", 4, 4, 1, 1.5 * HOUR), ("b", 3, 3, 1, 1.5 * HOUR), ("b", 6, 6, 1, 1.5 * HOUR), ("c", 8, 8, 1, 1.5 * HOUR)]
    assert streams.dropped(queries) == 1


LESSON = "course long, number long, version string, title string, concepts array<string>, definitions array<string>, topic string, symbols array<struct<symbol:string,meaning:string>>"


def lessons(seed):
    import random

    rng = random.Random(seed)
    rows = []
    for k in range(120):
        symbols = [(f"s{rng.randrange(9)}", f"m{k}.{j}") for j in range(rng.randrange(3))]
        rows.append((rng.randrange(3), rng.randrange(1, 15), f"{k:04d}", f"t{k}", [f"c{k}"], [f"d{k}"], f"x{k}", symbols))
    return rows + [(1, None, "9999", "no number", [], [], "", []), (0, 99, "0500", None, None, None, None, None)]


@pytest.mark.parametrize("parts", [1, 4])
def test_course_memory_is_that_of_the_batch_tables(spark, parts):
    """However the rows are cut into batches, and over restarts, state gives what upsert, compaction and symbol merge give."""
    rows = spark.createDataFrame(lessons(parts), LESSON)
    memory = KeyedTable(spark, new_dir(spark, "memory"), stateful.schema_of(stateful.COURSE), "course", buckets=2)
    run = lambda r, log: stateful.drain(stateful.course_memory(r, keep=3, most=4), log, write=stateful.memory_into(memory), mode="update")
    stateful.replay(spark, rows, [F.floor(F.col("version").cast("int") * parts / 600) == k for k in range(parts)] + [F.col("version") == "9999"], run)
    known = rows.where("number is not null")
    last = context.compact(context.upsert(known, ["course", "number"], [F.col("version").desc()]), "course", "number", ["concepts", "definitions"], keep=3)
    want = {(r["course"], r["number"]): (r["version"], r["title"], r["concepts"], r["definitions"], r["topic"]) for r in last.collect()}
    said = known.select("course", "version", F.posexplode("symbols").alias("p", "s")).select("course", "version", "p", "s.*")
    merged = context.merge_symbols(said, "course", "symbol", "meaning", F.struct("version", "p"), most=4).collect()
    got = {r["course"]: r for r in memory.read().collect()}
    assert {(c, x["number"]): (x["version"], x["title"], x["concepts"], x["definitions"], x["topic"]) for c, r in got.items() for x in r["lessons"]} == want
    places = {c: {x["symbol"]: x["place"] for x in r["symbols"]} for c, r in got.items()}
    assert all(len(p) == 4 for p in places.values())
    meanings = {(r["course"], r["symbol"]): (r["place"]["version"], r["meaning"]) for r in merged}
    for c, r in got.items():
        for x in r["symbols"]:
            if (c, x["symbol"]) in meanings:  # symbols of one lesson share a place
                assert meanings[c, x["symbol"]] == (x["place"], x["meaning"])
        assert r["next_number"] == max(n for k, n in want if k == c) + 1


@pytest.mark.parametrize("at_once", [1000, 5])
def test_course_memory_is_merged_without_a_call_by_course(spark, at_once, monkeypatch):
    """No state by key in Python; a course of many rows, one without numbers, rows without a version, and limits that change."""
    monkeypatch.setattr(stateful, "COURSE_ROWS", at_once, raising=False)
    row = lambda course, number, version, *symbols: (course, number, version, f"t{version}", ["c"], ["d"], "x", [(s, f"{s}{version}") for s in symbols])
    many = [row(7, k % 5, f"{k:04d}", f"s{k % 3}") for k in range(40)]
    rows = [row(1, 1, "0100", "a", "b"), row(1, 1, None, "a"), row(1, 2, None, "c"), row(2, None, "0100", "z"), row(1, 3, "0300", "a", "d"), row(1, 1, "0310", "b"), (3, -5, "0300", None, None, None, None, None)]
    memory = KeyedTable(spark, new_dir(spark, "memory"), stateful.schema_of(stateful.COURSE), "course", buckets=2)
    limits = iter([(9, 9), (2, 3)])

    def run(r, log):
        keep, most = next(limits)
        return stateful.drain(stateful.course_memory(r, keep, most), log, write=stateful.memory_into(memory), mode="update")

    early = F.coalesce("version", F.lit("0")) < "0200"
    queries = stateful.replay(spark, spark.createDataFrame(many + rows, LESSON), [early, ~early], run)
    assert not any(q.lastProgress["stateOperators"] for q in queries)
    got = {r["course"]: r for r in memory.read().collect()}
    assert [(x["number"], x["version"], x["concepts"]) for x in got[1]["lessons"]] == [(1, "0310", None), (2, None, ["c"]), (3, "0300", ["c"])]
    assert [(x["symbol"], x["place"], x["meaning"]) for x in got[1]["symbols"]] == [("a", "0100", "a0300"), ("b", "0100", "b0310"), ("d", "0300", "d0300")]
    assert [(x["symbol"], x["place"], x["meaning"]) for x in got[1]["rest"]] == [("c", None, None)]
    assert (got[1]["next_number"], got[2]["next_number"], got[3]["next_number"], got[2]["lessons"], got[2]["symbols"]) == (4, 1, -4, [], [])
    assert [(x["number"], x["version"]) for x in got[7]["lessons"]] == [(k, f"{35 + k:04d}") for k in range(5)]
    assert [(x["symbol"], x["place"], x["meaning"]) for x in got[7]["symbols"]] == [("s0", "0000", "s00039"), ("s1", "0001", "s10037"), ("s2", "0002", "s20038")]


def test_log_tail_marks_ends_by_timer_and_by_row(spark):
    out = new_dir(spark, "tail")
    parts = [
        [(1, 0, 1, "running", "one"), (1, 10, 2, "done", "two  "), (2, 5, 3, "error", "")],  # a finished job that goes on
        [(1, 500, 4, "done", "three"), (3, 510, 5, "running", "  "), (3, 511, 6, "running", None)],  # 2 ends by timer, 1 before its third line
        [(3, 2000, 7, "running", "four")],  # 1 ends again, 3 is running
    ]
    arrive(spark, parts, "job long, t long, seq long, status string, line string", lambda r, log: stateful.drain(stateful.log_tail(r, 100), log, path=out))
    got = sorted((r["job"], r["characters"], r["line"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 4, "one"), (1, 10, "[FINE]"), (1, 10, "two"), (1, 16, "[FINE]"), (1, 16, "three"), (2, 1, "[FINE]"), (3, 9, "four")]


@pytest.mark.parametrize("parts", [[0], [0, 1, 2]])
def test_heartbeats_do_not_depend_on_batches(spark, parts):
    rows = [(1, 0, 1, "running"), (2, 50, 2, "running"), (1, 52, 3, "done"), (1, 100, 4, "running"), (3, 400, 5, "queued"), (1, 400, 6, "done")]
    cut = [rows] if len(parts) == 1 else [rows[:2], rows[2:4], rows[4:]]
    out = new_dir(spark, "beats")
    arrive(spark, cut, "job long, t long, seq long, status string", lambda r, log: stateful.drain(stateful.heartbeats(r, every=15, estimate=100, limit=90), log, path=out))
    got = sorted((r["job"], r["passed"], r["progress"], int(r["at"].timestamp()) - START) for r in spark.read.parquet(out).collect())
    steps = [(1, 0, range(15, 52, 15)), (2, 50, range(15, 91, 15)), (1, 100, range(15, 91, 15))]
    assert got == sorted((j, p, int(10 + min(p / 100, 0.95) * 30), t + p) for j, t, passed in steps for p in passed)


def test_the_board_is_that_of_the_batch_after_every_part(spark):
    """Jobs that change their status, go for newer ones, and expire."""
    import random

    rng = random.Random(8)
    rows = [(k % 70, 10 * k, rng.choice(["queued", "running", "done", "error"])) for k in range(300)]
    parts = [rows[:100], rows[100:180], rows[180:]]
    table = KeyedTable(spark, new_dir(spark, "board"), stateful.schema_of(stateful.BOARD), "job", buckets=4)
    after = []

    def run(r, log):
        q = stateful.drain(stateful.job_board(r, cap=40, shards=3), log, write=stateful.board_into(table), mode="update")
        after.append(sorted((x["job"], x["status"]) for x in stateful.board(table, 40).collect()))
        return q

    arrive(spark, parts, "job long, t long, status string", run)
    for k in range(3):
        so_far = at(spark, [r for p in parts[: k + 1] for r in p], "job long, t long, status string")
        want = jobs.evict(jobs.latest_state(so_far, "job", ["ts"]), "status", ["ts", "job"], cap=40)
        assert after[k] == sorted((r["job"], r["status"]) for r in want.collect())
    aged = KeyedTable(spark, new_dir(spark, "aged"), stateful.schema_of(stateful.BOARD), "job", buckets=4)
    arrive(spark, parts, "job long, t long, status string", lambda r, log: stateful.drain(stateful.job_board(r, cap=500, age=400, shards=3), log, write=stateful.board_into(aged), mode="update"))
    last = {j: (t, s) for j, t, s in rows}
    assert sorted((r["job"], r["status"]) for r in aged.read().collect()) == sorted((j, s) for j, (t, s) in last.items() if s in ("queued", "running") or t >= 2990 - 400)


def test_the_board_takes_a_batch_by_aggregates(spark):
    """No row of a batch goes through a Python state operator; what no batch brings ages as the watermark moves; equal and late rows; a job of no id."""
    parts = [
        [(1, 0, "running"), (2, 5, "done"), (3, 6, "error"), (4, 6, "queued"), (None, 7, "running"), (5, 8, None), (1, 9, "running"), (1, 9, "done")],
        [(4, 50, "done"), (2, 8, "error"), (6, 60, "running")],  # 2 comes late
        [(6, 200, "running")],  # nothing of what goes is in this batch
    ]
    table = KeyedTable(spark, new_dir(spark, "board"), stateful.schema_of(stateful.BOARD), "job", buckets=8)
    after = []

    def run(r, log):
        q = stateful.drain(stateful.job_board(r, cap=3, age=100, shards=3), log, write=stateful.board_into(table), mode="update")
        assert q.lastProgress["stateOperators"] == []
        after.append({x["job"]: (x["status"], x["created"] // 1000 - START, x["said"]) for x in table.read().collect()})
        return q

    arrive(spark, parts, "job long, t long, status string", run)
    active = {None: ("running", 7, 0), 5: (None, 8, 0)}
    assert after[0] == active | {1: ("done", 9, 0), 2: ("done", 5, 0), 3: ("error", 6, 0), 4: ("queued", 6, 0)}
    assert after[1] == active | {1: ("done", 9, 0), 3: ("error", 6, 0), 4: ("done", 50, 1), 6: ("running", 60, 1)}  # only changes are told
    assert after[2] == active | {6: ("running", 200, 2)}
    assert {x["job"] for x in stateful.board(table, 3).collect()} == {None, 5, 6}

"""Stored states of any age in one column: VARIANT values, migrated step by step, read with types.

A state is JSON, or of the oldest kind lines `name=value`. `as_state` makes a VARIANT of either; a text that is neither is
null, as a state that cannot be read counts as none. `version_of` tells how old a state is by what it has, and `read_run` and
`read_job` read the fields of all versions with their defaults, so old and new rows stay side by side in one table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = r"^-?(0|[1-9][0-9]{0,17})$"
LESSONS = "array<struct<number:bigint,title:string>>"
RUNS = "array<struct<run:bigint,lessons:array<bigint>>>"


def from_lines(text: Column) -> Column:
    """`name=value` lines as JSON: whole numbers as numbers, other values as strings; lines without = and nameless ones are left out."""
    rows = F.filter(F.split(text, r"\r?\n"), lambda x: F.instr(x, "=") > 1)
    name = lambda x: F.trim(F.substring_index(x, "=", 1))
    names = F.transform(rows, name)
    last = F.filter(rows, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), name(x)))  # a name that comes later again
    value = lambda x: F.trim(F.regexp_replace(x, "(?s)^[^=]*=", ""))
    shown = lambda v: F.when(v.rlike(WHOLE), v).otherwise(quoted(v))
    pairs = F.transform(last, lambda x: F.concat(quoted(name(x)), F.lit(":"), shown(value(x))))
    return F.when(F.size(rows) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")


def as_state(text: Column) -> Column:
    """VARIANT of a stored text, null where it is neither JSON nor lines of values; of a name that comes twice the last value."""
    json = F.try_parse_json(text)
    return F.when(text.rlike(r"^\s*\{"), json).otherwise(F.try_parse_json(from_lines(text)))


def field(state: Column, path: str, kind: str, default=None) -> Column:
    """A field with a type; null or a value of another type gives the default."""
    value = F.try_variant_get(state, f"$.{path}", kind)
    return value if default is None else F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def version_of(state: Column) -> Column:
    """0: counters without lessons, 1: lessons without runs, 2: with runs; null: no state."""
    has = lambda path: F.try_variant_get(state, f"$.{path}", "variant").isNotNull()
    return F.when(state.isNull(), None).when(has("runs") | has("next_run"), 2).when(has("lessons"), 1).otherwise(0)


def read_run(state: Column) -> Column:
    """struct<version, course_title, subject, next_lesson, next_run, lessons, runs, counter>: what a course has got to, whatever its age."""
    lessons = field(state, "lessons", LESSONS, F.expr(f"cast(array() as {LESSONS})"))
    runs = field(state, "runs", RUNS, F.expr(f"cast(array() as {RUNS})"))
    after = lambda numbers: F.coalesce(F.array_max(numbers), F.lit(0)) + 1
    return F.struct(
        version_of(state).alias("version"), field(state, "course_title", "string", "").alias("course_title"), field(state, "subject", "string", "generico").alias("subject"),
        field(state, "next_lesson", "bigint", after(F.transform(lessons, lambda x: x.number))).alias("next_lesson"), field(state, "next_run", "bigint", after(F.transform(runs, lambda x: x.run))).alias("next_run"),
        lessons.alias("lessons"), runs.alias("runs"), field(state, "k", "bigint", 0).alias("counter"),
    )


def read_job(state: Column) -> Column:
    """struct<status, stdout, stderr, created_at>: a stored job as a server finds it when it starts: what was running has failed."""
    status = field(state, "status", "string", "error")
    running = status == "running"
    return F.struct(
        F.when(running, "error").otherwise(status).alias("status"), field(state, "stdout", "string", "").alias("stdout"),
        F.when(running, "interrupted").otherwise(field(state, "stderr", "string", "")).alias("stderr"), field(state, "created_at", "timestamp").alias("created_at"),
    )

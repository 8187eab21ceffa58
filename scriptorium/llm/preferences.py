"""Chat formatting of preferences, in SQL functions only.

A pair has a chosen and a rejected conversation, each an array of turns (role, text). Their longest common
prefix of turns is rendered once as the prompt; what is left of each is rendered as a completion with a mask:
of its segments, those that the assistant wrote are trained on (1), headers and other turns are not (0).

Pairs are made of a table of turns in two ways. `same_prompt`: conversations with the same first turn belong
to one prompt; the one with the most assistant text is chosen (ties: the smallest conv_id), and every other
that differs from it is rejected against it. The leader of a group is an aggregate, so a prompt that a third of
all conversations share is no larger in any task than one that two share. `other_reply`: a conversation up to
its last assistant turn is chosen, and the same with the last reply of the next conv_id is rejected.

Whole conversations are written before they are joined, so turns are gathered once. Leaders go to the conversations, not
these to them: by broadcast where a count and their length allow it, else as copies that each serve a share of the prompt.

Defined results: null texts and roles are empty; turns with equal numbers go by role, then text; repeated rows
are repeated turns; rows with null conv_id give no pairs; pairs of equal conversations are left out; a
conversation of any length is one row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize

#: Rows that may be broadcast, and characters of leaders' turns; conversations of a prompt that one copy of its leader serves.
BROADCAST_ROWS, BROADCAST_BYTES, DEALT = 300_000, 16 << 20, 5_000
#: The markup of a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """How many first turns two conversations share."""
    differ = F.zip_with(chosen, rejected, lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1))
    return F.when(F.array_position(differ, 1) > 0, F.array_position(differ, 1) - 1).otherwise(F.least(F.size(chosen), F.size(rejected))).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.text, F.lit(CLOSE))), "")


def segments(turns: Column) -> Column:
    """array<struct<text, train>>: header and body of each turn."""
    header = lambda t: F.struct(F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE)).alias("text"), F.lit(0).alias("train"))
    body = lambda t: F.struct(F.concat(t.text, F.lit(CLOSE)).alias("text"), F.when(t.role == "assistant", 1).otherwise(0).alias("train"))
    return F.flatten(F.transform(turns, lambda t: F.array(header(t), body(t))))


def mask(parts: Column) -> Column:
    """start:end of the trained characters of a completion, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = acc.at + F.length(s.text)
        span = F.concat_ws(":", acc.at.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(s.train == 1, F.concat(acc.out, F.array(span))).otherwise(acc.out).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: F.array_join(acc.out, ","))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replaces the two columns of turns by prompt, prompt_turns, and a completion and mask of each side."""
    d = pairs.withColumn("prompt_turns", common_prefix(F.col(chosen), F.col(rejected)))
    rest = lambda c: F.slice(F.col(c), F.col("prompt_turns") + 1, F.size(c))
    d = d.withColumn("prompt", rendered(F.slice(F.col(chosen), F.lit(1), F.col("prompt_turns"))))
    for c in (chosen, rejected):
        d = d.withColumns({f"{c}_completion": rendered(rest(c)), f"{c}_mask": mask(segments(rest(c)))})
    return d.drop(chosen, rejected)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: whole conversations in order; texts and roles are not null."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def same_prompt(c: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, chosen, rejected of conversations that begin alike."""
    written = F.aggregate(F.filter("turns", lambda t: t.role == "assistant"), F.lit(0).cast("long"), lambda n, t: n + F.length(t.text))
    c = c.select("conv_id", "turns", F.sha2(F.to_json(F.slice("turns", 1, 1)), 256).alias("first"), written.alias("written"), F.sha2(F.to_json("turns"), 256).alias("whole"))
    best = F.min(F.struct((-F.col("written")).alias("w"), F.col("conv_id"), F.col("whole")))
    leaders = c.groupBy("first").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1").select("first", F.col("best.conv_id").alias("chosen_id"), F.col("best.whole").alias("chosen_whole"), F.ceil(F.col("n") / DEALT).cast("int").alias("salts"))
    leaders = materialize(leaders, "leaders")
    few = leaders.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # beyond, the join shuffles and splits hot prompts
    of = F.broadcast(leaders) if few else leaders
    chosen = materialize(c.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")).join(F.broadcast(leaders.select("chosen_id", "salts")) if few else leaders.select("chosen_id", "salts"), "chosen_id"), "chosen")
    pairs = c.join(of, "first").where(F.col("whole") != F.col("chosen_whole")).select("chosen_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"), "salts")
    size = chosen.agg(F.sum(F.aggregate("chosen", F.lit(0).cast("long"), lambda n, t: n + F.length(t.text) + 64))).first()[0] or 0
    if few and size <= BROADCAST_BYTES:
        return pairs.join(F.broadcast(chosen.drop("salts")), "chosen_id").select("chosen_id", "rejected_id", "chosen", "rejected")
    # a leader goes to as many places as its prompt has rows, so no task gets all conversations of a hot prompt
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("rejected_id"), F.col("salts")).cast("int")).drop("salts")
    dealt = chosen.select("chosen_id", "chosen", F.explode_outer(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return pairs.join(dealt, ["chosen_id", "salt"]).select("chosen_id", "rejected_id", "chosen", "rejected")


def other_reply(c: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, chosen, rejected: the last reply against that of the next conversation."""
    back = F.array_position(F.reverse(F.transform("turns", lambda t: t.role == "assistant")), True)
    c = c.withColumn("last", F.when(back > 0, F.size("turns") - back + 1).cast("int")).where("last is not null")
    c = c.withColumn("reply", F.get("turns", F.col("last") - 1).text)
    after = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("reply").alias("other"))
    rejected = F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array(F.struct(F.lit("assistant").alias("role"), F.col("other").alias("text"))))
    pairs = c.join(after, "conv_id").where(F.col("reply") != F.col("other"))
    return pairs.select(F.col("conv_id").alias("chosen_id"), (F.col("conv_id") + 1).alias("rejected_id"), F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), rejected.alias("rejected"))


def preferences(turns: DataFrame) -> DataFrame:
    """One row for each pair: made (how), chosen_id, rejected_id, prompt_turns, prompt, completions and masks."""
    c = materialize(conversations(turns.where(F.col("conv_id").isNotNull())), "conversations")
    pairs = same_prompt(c).withColumn("made", F.lit("same_prompt")).unionByName(other_reply(c).withColumn("made", F.lit("other_reply")))
    return format_pairs(pairs)

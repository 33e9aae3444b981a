"""Multi-party perspective rotation of dialogues.

For each participant of a dialogue the whole dialogue is rendered once, with
that participant as the assistant and all others as users with names, and with
the spans of text that a model should learn: the assistant's turns and their
end marks. System turns are shown in each rendering and are no participant.

Turns come in the order of their number (NULL first), then of speaker and of the
SHA-256 of the text, and each ``part_turns`` of them, counted from the start of
the dialogue, are a part, whatever the size of the dialogue. Spans count from
the start of a part. So a dialogue that fills a third of the table is many
rows, in order of their column ``part``, and no task or row holds more of it
than a part: ranks come from a range partitioning over all turns and the number
of turns that a dialogue has in earlier partitions.

NULL is a dialogue, a turn number and a speaker (named "unknown") of its own;
NULL text is empty. Rows that repeat are rendered as often; they are counted
before anything is shuffled. A text of any length is rendered whole. Marks
inside a text are broken up by a space. Dialogues without a participant, and an
empty table, have no rendering. Other columns of the input are not read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import materialise

# Turns of a part.
PART_TURNS = 512
# Marks around a turn, and the roles that are no participants.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = ("system",)
UNKNOWN = "unknown"


def _ranked(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``copies``, how often each occurs, and ``start``, the rank of the first in its dialogue.

    A written table holds the sorted rows with the task that sorted them.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("digest")]
    alike = turns.withColumn("digest", F.sha2("text", 256)).groupBy("conv", "turn", "speaker", "digest", "text").agg(
        F.count(F.lit(1)).alias("copies")
    )
    # Rows are distinct by now, so the ranges of a dialogue that has a third of them are as even as others.
    placed = materialise(
        alike.repartitionByRange(F.col("conv").asc_nulls_first(), *order).withColumn("task", F.spark_partition_id())
    )
    earlier = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("conv", "task").agg(F.sum("copies").alias("n")).withColumn("before", F.sum("n").over(earlier))
    before = before.where("before > 0").select(F.col("conv").alias("of"), F.col("task").alias("at"), "before")
    # Only the first dialogue of a task has turns in earlier ones, so this is at most a row per task.
    found = placed.join(
        F.broadcast(before), (F.col("task") == F.col("at")) & F.col("conv").eqNullSafe(F.col("of")), "left"
    )
    inside = F.sum("copies").over(
        Window.partitionBy("task", "conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return found.withColumn("start", F.coalesce("before", F.lit(0)) + inside - F.col("copies")).select(
        "conv", "turn", "speaker", "digest", "text", "copies", "start"
    )


def _parts(ranked: DataFrame, part_turns: int) -> DataFrame:
    """Rows ``(conv, part, turns)`` with the turns of a part in order, repeated ones as often as they occur."""
    end = F.col("start") + F.col("copies")
    cut = ranked.withColumn(
        "part", F.explode(F.sequence(F.floor(F.col("start") / part_turns), F.floor((end - 1) / part_turns)))
    )
    copies = F.least(end, (F.col("part") + 1) * part_turns) - F.greatest("start", F.col("part") * part_turns)
    turns = F.sort_array(F.collect_list(F.struct("turn", "speaker", "digest", "text", copies.cast("int").alias("copies"))))
    return cut.groupBy("conv", "part").agg(turns.alias("turns")).withColumn(
        "turns", F.flatten(F.transform("turns", lambda x: F.array_repeat(F.struct(x["speaker"], x["text"]), x["copies"])))
    )


def _marked_up(x: Column, perspective: Column, systems: Column) -> Column:
    head = (
        F.when(F.array_contains(systems, x["speaker"]), F.lit("system"))
        .when(x["speaker"] == perspective, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), x["speaker"]))
    )
    body = F.replace(x["text"], F.lit("<|"), F.lit("< |"))
    return F.struct(
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat(body, F.lit(CLOSE)).alias("body"),
        ((x["speaker"] == perspective) & ~F.array_contains(systems, x["speaker"])).alias("learn"),
    )


def rotate(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    system: Sequence[str] = SYSTEM, part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row per dialogue, perspective and part.

    Columns: conversation, perspective, part (from 0), n_turns, text, and spans,
    an array of (start, end) in characters of ``text``, end excluded.
    """
    # A speaker's name cannot end its line or hold a mark.
    name = F.regexp_replace(F.coalesce(named(speaker).cast("string"), F.lit(UNKNOWN)), r"[\r\n]+|<\|", " ")
    rows = turns.select(
        named(conversation).alias("conv"), named(turn).alias("turn"), name.alias("speaker"),
        F.coalesce(named(text).cast("string"), F.lit("")).alias("text"),
    )
    systems = F.array(*[F.lit(s) for s in system]).cast("array<string>")
    ranked = _ranked(rows)
    parts = _parts(ranked, part_turns)
    speakers = ranked.where(~F.array_contains(systems, F.col("speaker"))).select(
        F.col("conv").alias("of"), F.col("speaker").alias("perspective")
    ).distinct()
    seen = parts.join(speakers, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    segments = F.transform("turns", lambda x: _marked_up(x, F.col("perspective"), systems))
    seen = seen.withColumn("segments", segments)
    # Each step adds a turn: where it ended, and the spans so far.
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["head"]) + F.length(x["body"]) + 1).alias("at"),
            F.when(x["learn"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(x["head"])).alias("start"),
                (s["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"),
            )))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return seen.select(
        F.col("conv").alias(conversation), "perspective",
        "part", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("segments", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        spans.alias("spans"),
    )

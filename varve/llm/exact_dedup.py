"""Exact copies by two-pass Bloom filtering.

The first pass reads the texts and keeps only eight-byte hashes. Each hash sets
``HASHES`` of ``2**filter_bits`` positions; positions that were set twice form
the filter, as a table of 64-bit words. A text of which some position was set
once has no copy. The second pass probes the words: rows that miss go straight
through, and only rows that hit (all copies, and a few false alarms) shuffle
and are grouped exactly.

The filter is broadcast. It has ``2**(filter_bits - 6)`` words of 16 bytes at
most, whatever the input. A filter that is small for its input raises more
false alarms, never wrong results.

Texts are equal when identical after lower-casing A-Z. A NULL text counts as
the empty one, so empty texts are copies of each other. Of equal texts the row
with the largest key stays (NULL is the smallest key, and of rows that repeat
text and key one stays). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import ascii_lower, fresh, materialise, pick, whole_text

# Positions per text, and bits of the filter: 2**27 bits are 2**21 words.
HASHES = 2
FILTER_BITS = 27


def _positions(text: Column, filter_bits: int) -> list[Column]:
    # Texts that are equal after folding A-Z are equal after lower() as well, which is far cheaper.
    h = F.xxhash64(F.lower(text))
    top = F.shiftrightunsigned(h, 64 - filter_bits)
    return [top, h.bitwiseAND(2**filter_bits - 1)][:HASHES]


def repeated_positions(docs: DataFrame, text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """First pass: rows ``(word, bits)`` of the positions that were set at least twice."""
    if not 7 <= filter_bits <= 28:
        raise ValueError("filter_bits must be from 7 to 28")
    spots = docs.select(F.explode(F.array(*_positions(whole_text(named(text)), filter_bits))).alias("spot"))
    twice = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = twice.groupBy(F.shiftright("spot", 6).alias("word"))
    return materialise(words.agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")))


def flag_possible_copies(docs: DataFrame, text: str, flag: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Second pass: ``docs`` with a boolean ``flag`` that is false only for texts without a copy."""
    found = repeated_positions(docs, text, filter_bits)
    out, hits, extra = docs, [], []
    for i, position in enumerate(_positions(whole_text(named(text)), filter_bits)):
        spot, word, bits = fresh(out, f"spot{i}", f"word{i}", f"bits{i}")
        # At most 2**(filter_bits - 6) rows of two longs.
        words = F.broadcast(found.select(F.col("word").alias(word), F.col("bits").alias(bits)))
        out = out.withColumn(spot, position)
        out = out.join(words, F.shiftright(named(spot), 6) == named(word), "left")
        inside = named(spot).bitwiseAND(63).cast("int")
        hits.append(F.getbit(F.coalesce(named(bits), F.lit(0).cast("long")), inside) == 1)
        extra += [spot, word, bits]
    hit = hits[0]
    for other in hits[1:]:
        hit = hit & other
    return out.withColumn(flag, hit).drop(*extra)


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the folded text in UTF-8."""
    return F.sha2(ascii_lower(whole_text(text)), 256)


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    What both branches read is a written table of keys and digests, so its row
    numbers are fixed.
    """
    (flag,) = fresh(docs, "may_repeat")
    probed = flag_possible_copies(docs.select(*pick(docs, dict.fromkeys([key, text]))), text, flag, filter_bits)
    marks = materialise(probed.select(
        named(key).alias("key"), text_digest(named(text)).alias("text_sha256"), named(flag).alias("may_repeat"),
        F.monotonically_increasing_id().alias("row"),
    ))
    single = marks.where("not may_repeat").select(
        "key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "text_sha256",
    )
    rows = marks.where("may_repeat").select("key", "text_sha256", "row")
    # Combined before the shuffle, so a text that fills a third of the table is one row per task. As a
    # written table the groups leave the join its own shuffles, whose large partitions Spark can split.
    groups = materialise(rows.groupBy("text_sha256").agg(
        F.max(F.struct("key", "row")).alias("last"), F.count(F.lit(1)).alias("group_size")
    ))
    several = rows.join(groups, "text_sha256").select(
        "key", F.col("last.key").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(several).withColumnRenamed("key", key)


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    (flag,) = fresh(docs, "may_repeat")
    probed = flag_possible_copies(docs, text, flag, filter_bits)
    single = probed.where(~named(flag)).drop(flag)
    row = F.struct(*pick(docs, docs.columns)).alias("row")
    several = probed.where(named(flag)).select(
        text_digest(named(text)).alias("digest"), F.struct(named(key)).alias("last"), row
    )
    # The struct around the key is never NULL, so a group of NULL keys keeps a row, too.
    stay = several.groupBy("digest").agg(F.max_by("row", "last").alias("row"))
    return single.unionByName(stay.select("row.*"))

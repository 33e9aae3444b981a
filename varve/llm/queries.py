"""The registered queries on corpora, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from varve.llm import (
    chat, decontaminate, exact_dedup, langid, line_dedup, lm_score, mixing, oracles, periodic, quality, shingle_join, structure, topk, url_rules,
)
from varve.llm.common import read, whole_text

Query = Callable[[SparkSession, str], DataFrame]

# The rules of the address query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with the trigrams of all documents of a known language."""
    return langid.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents").select("text", "lang"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "votes", "label", "quality", "accepted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.drop_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(read(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A table of values in the plan; a list of Python rows would go through Python workers.
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    out = url_rules.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renderings with a digest of their text and their spans as ``start-end`` pairs."""
    out = chat.rotate(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.select(
        "conv_id", "perspective", "part", F.col("n_turns").cast("long").alias("n_turns"), F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"), spans.alias("spans"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold 2 of 7 is not learned from; fold 6 teaches the mixture weights."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = lm_score.fold_of(F.col("doc_id"))
    return lm_score.score_texts(docs, training=fold != 2, held_out=fold == 6)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.coverage(docs, read(spark, sf_dir, "benchmark"), tile_from=0.0)
    return out.select("doc_id", "coverage", F.col("covered_item").alias("item_id"), "n_tiles", "contaminated")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs)


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", topk.integer_weights(F.col("embedding"), 1024).alias("weights"))
    return topk.top_inner_products(rows, F.col("vec_id") % 100 == 0)


def _damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by the digest of their place: dropped (not ``present``), emptied, left open, doubled, given to the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") != 0).alias("present"), F.explode(times).alias("copy"),
    )


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and a digest of the repaired turns of every conversation."""
    turns = _damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    found = structure.repair(turns, present=F.col("present"))
    made = structure.digests(found.turns).withColumnsRenamed({"conv_id": "of", "sha256": "repaired_sha256"})
    return found.reports.join(made, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))
    )


def _with_planted_runs(key: Column, text: Column) -> Column:
    """In a tenth of the texts, chosen by key, the words from one on repeat with a period; others stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(words, i.cast("int"))), " ")).otherwise(F.lit(""))

    # The words are bound to a name once and not split again for each place.
    words = F.regexp_extract_all(whole_text(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), planted), 0)).otherwise(whole_text(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, with digests of the list of runs and of the text without repeats."""
    docs = read(spark, sf_dir, "documents").select("doc_id", _with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.find_runs(docs).withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")
    ))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
} | {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality_classifier, op3_line_dedup, op4_exact_dedup, op5_url_filters,
        op6_chat_formatting, op7_lm_scoring, op8_ngram_jaccard_join,
        op9_decontamination, op10_mixing, op11_exact_topk,
        op12_structure_repair, op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

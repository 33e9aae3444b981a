"""Language of pages by Bayesian evidence fusion.

Four kinds of evidence are combined per page. The text's likelihood under byte
trigram models, one per language, counted over all labelled texts. The language
that the markup declares, with its reliability as found on all pages. And a
prior of the host that is smoothed hierarchically: the counts of a host lean on
those of its address suffix, and these on those of all pages. The counts are
sums of the text's posteriors by grouped aggregation; a page's own share is
left out of its host's counts.

Hosts are aggregated before they shuffle, so a host with a third of all pages
is one row per task, and its pages are split where they meet its prior. Models
have languages x slots numbers, whatever the input.

NULL and empty pages have no text evidence, a NULL or malformed address has an
empty host and suffix, and a missing declaration says nothing; what is left
decides, and of equal posteriors the first language by name. Rows that repeat
get the same result. A page of any length is read whole; its trigrams weigh as
much as ``EVIDENCE`` of them. Without any labelled text the trigrams say
nothing; a table without pages gives an empty table. Other columns of the input
are not read, so their names cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import ascii_lower, materialise, whole_text
from varve.llm.words import GOLDEN, plain_words
from varve.session import ship

LANGUAGES = ("de", "en", "es", "fr")
# Slots of the trigram models, as a power of two.
SLOT_BITS = 15
# Trigrams that count as independent evidence, at most: a long text says little more than a page.
EVIDENCE = 200.0
# Pages that a level of the hierarchy weighs in the level below.
STRENGTH = 5.0
# Pseudo-counts of a trigram, and of a declaration.
TRIGRAM_COUNT, DECLARED_COUNT = 0.5, 1.0

_ADDRESS = r"(?s)^.*?://([^/?#]*)"
# What holds no prose, then any tag; and the declared language.
_NO_PROSE = re.compile(r"<!--.*?-->|<(script|style|nav|head|footer|noscript)\b.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def visible_text(page: str) -> str:
    return entities.unescape(_TAG.sub(" ", _NO_PROSE.sub(" ", page)))


def declared_language(page: str) -> str | None:
    found = _DECLARED.search(page)
    return found[1].lower() if found else None


def trigram_slots(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the words, which are set apart by single spaces."""
    b = np.frombuffer(b" " + b" ".join(plain_words(text)) + b" ", dtype=np.uint8).astype(np.uint64)
    if len(b) < 3:
        return np.empty(0, dtype=np.int64)
    grams = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
    return ((grams * GOLDEN) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _counted(languages: Sequence[str]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), 1 << SLOT_BITS), dtype=np.int64)
        for batch in batches:
            for t, k in zip(batch.column("text"), batch.column("language").to_pylist()):
                sums[k] += np.bincount(trigram_slots(t.as_py()), minlength=sums.shape[1])
        k, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(slot, pa.int32()), pa.array(sums[k, slot])], names=["language", "slot", "n"]
        )

    return count


def trigram_models(texts: DataFrame, text: str, language: str, languages: Sequence[str]) -> np.ndarray:
    """Log probabilities, languages x slots, from all rows of a known language."""
    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.lower(named(language))).cast("int") - 1
    rows = texts.select(whole_text(named(text)).alias("text"), number.alias("language")).where("language >= 0")
    counts = rows.mapInArrow(_counted(languages), "language int, slot int, n long")
    sums = np.full((len(languages), 1 << SLOT_BITS), TRIGRAM_COUNT)
    # Languages x slots rows at most.
    for k, slot, n in counts.groupBy("language", "slot").agg(F.sum("n")).collect():
        sums[k, slot] += n
    return np.log(sums / sums.sum(axis=1, keepdims=True))


def _read(held, languages: Sequence[str]) -> Callable:
    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        for batch in batches:
            declared, likelihoods, sizes = [], [], []
            for x in batch.column("page"):
                page = x.as_py() or ""
                slots = trigram_slots(visible_text(page))
                logs = models[:, slots].sum(axis=1) * min(1.0, EVIDENCE / max(1, len(slots)))
                logs -= logs.max()
                likelihoods.append(np.exp(logs).clip(1e-300).tolist())
                sizes.append(len(slots))
                declared.append(declared_language(page))
            columns = [batch.column(n) for n in ("key", "host", "suffix")]
            columns += [
                pa.array(declared, pa.string()), pa.array(sizes, pa.int64()), pa.array(likelihoods, pa.list_(pa.float64())),
            ]
            fields = [batch.schema.field(n) for n in ("key", "host", "suffix")]
            fields += [pa.field("declared", pa.string()), pa.field("trigrams", pa.int64()), pa.field("likelihood", pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return see


def _normal(values: Column) -> Column:
    return F.transform(values, lambda v: v / F.aggregate(values, F.lit(0.0), lambda a, b: a + b))


def _product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _sums(n: int, values: str) -> Column:
    return F.array(*[F.sum(F.get(values, F.lit(i))) for i in range(n)])


def identify(
    pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", page: str = "html",
    text: str = "text", language: str = "lang", languages: Sequence[str] = LANGUAGES,
) -> DataFrame:
    """One row per page: key, host, suffix, declared, text_language, language, confidence."""
    languages, n = sorted(languages), len(languages)
    spark = pages.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(trigram_models(labelled, text, language, languages).astype(np.float32))
    host = F.coalesce(ascii_lower(F.regexp_extract(named(url), _ADDRESS, 1)), F.lit(""))
    host = F.regexp_replace(host, r":\d*$", "")
    rows = pages.select(named(key).alias("key"), host.alias("host"), whole_text(named(page)).alias("page"))
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    kind = rows.schema["key"].dataType.simpleString()
    seen = materialise(rows.select("key", "host", "suffix", "page").mapInArrow(
        _read(held, languages),
        f"key {kind}, host string, suffix string, declared string, trigrams long, likelihood array<double>",
    ).withColumn("share", _normal(F.col("likelihood"))))

    names = F.array(*[F.lit(x) for x in languages])
    # One row per host, combined before the shuffle; suffixes and the whole from these.
    hosts = seen.groupBy("host", "suffix").agg(_sums(n, "share").alias("sums"))
    suffixes = hosts.groupBy("suffix").agg(_sums(n, "sums").alias("sums"))
    whole = suffixes.agg(_sums(n, "sums")).first()[0]
    whole = np.array([x or 0.0 for x in whole]) + 1.0
    top = F.lit([float(x) for x in whole / whole.sum()])
    suffixes = suffixes.select(F.col("suffix").alias("end"), _normal(
        F.zip_with("sums", top, lambda s, p: s + STRENGTH * p)
    ).alias("end_prior"))
    # As a written table the priors leave the join with the pages its own shuffles, whose large partitions Spark can split.
    priors = materialise(hosts.join(suffixes, F.col("suffix") == F.col("end")).select(
        F.col("host").alias("site"), F.col("sums").alias("site_sums"), "end_prior"
    ))

    # How often pages of a language declare each language, by the posterior of their text.
    known = seen.where(F.array_contains(names, F.col("declared"))).groupBy("declared").agg(_sums(n, "share").alias("sums"))
    table = np.full((n, n), DECLARED_COUNT) + np.eye(n) * DECLARED_COUNT
    for r in known.collect():  # one row per language at most
        table[languages.index(r["declared"])] += np.array(r["sums"])
    table /= table.sum(axis=0, keepdims=True)  # declared x true
    says = F.coalesce(F.get(
        F.array(*[F.lit([float(x) for x in row]) for row in table]),
        (F.array_position(names, F.coalesce("declared", F.lit(""))) - 1).cast("int"),
    ), F.lit([1.0] * n))

    out = seen.join(priors, F.col("host") == F.col("site"))
    others = F.zip_with("site_sums", "share", lambda s, own: F.greatest(s - own, F.lit(0.0)))
    prior = F.zip_with(others, "end_prior", lambda s, p: s + STRENGTH * p)
    out = out.withColumn("posterior", _product(_product(F.col("likelihood"), prior), says))
    out = out.withColumn("posterior", _normal(F.col("posterior")))

    def best(values: str) -> Column:
        return F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))

    return out.select(
        F.col("key").alias(key), "host", "suffix", "declared",
        F.when(F.col("trigrams") > 0, best("share")).alias("text_language"),
        best("posterior").alias("language"), F.round(F.array_max("posterior"), 6).alias("confidence"),
    )

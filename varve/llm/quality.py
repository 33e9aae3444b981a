"""Quality by weak labels: heuristics vote, a label model weighs the votes, a linear scorer learns from it.

Each document gets the votes of overlapping heuristics: good, bad, or no
opinion. Votes are counted by pattern in one aggregation; their number is
bounded by three to the power of the heuristics. Expectation-maximisation on
these counts estimates, without any labelled row, how often each heuristic
votes what on good and on bad documents. The posterior of a document's pattern
is its soft label. A hashed linear scorer (byte trigrams, words, and the steps
of the heuristics' measures) is trained on the soft labels of a bounded sample
and scores all documents in a scan without a shuffle.

NULL counts as the empty text, on which no heuristic has an opinion. Texts are
measured whole, one at a time, so the longest text must fit a task. Texts that
repeat get the same score; in the sample, rows that repeat key and text are all
in or all out and go to the same share, in order of text where hashes tie. A
score of exactly ``keep`` is accepted. A NULL key is carried along. With an empty
table there is nothing to learn and nothing to score.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.llm.common import fresh, materialise, whole_text
from varve.llm.words import GOLDEN, WordHashes
from varve.session import ship

# Rows that the scorer is trained on: all of a table up to this size, and of a larger one about as
# many, those whose hash of (key, text) falls below that share of its range.
FIT_ROWS = 20_000
# Slots of the hashed features, as a power of two.
SLOT_BITS = 14
# Rows that each task visits between averages (its share again and again), rounds of averaging, tasks.
VISITS, ROUNDS, SHARES = 20_000, 3, 8
# First step, what it is divided by at the end of a round, and decay of the weights.
STEP, COOLING, DECAY = 0.5, 8, 1e-5
# Lengths of the words and of the measures beside the trigrams, whose length is 1.
WORDS_LENGTH, MEASURES_LENGTH = 0.5, 2.0
# A document is kept when its score reaches this probability.
KEEP = 0.5
LABEL_ROUNDS = 100
# Words from which on a text says enough about repetition.
LONG = 20

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#$%&*+<=>@[\\]^_`{|}~")] = True
_BLANK = list(b" \t\n\r\x0b\x0c")
_PLAIN = ~_SYMBOLS
_PLAIN[33] = False


def measures(data: bytes, words: list[bytes], times: Counter) -> dict[str, float]:
    """What the heuristics look at; a measure that a text does not have is absent."""
    out: dict[str, float] = {}
    n = len(words)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    out["symbols"] = float(counts[_SYMBOLS].sum()) / n
    out["shouts"] = float(counts[33]) / n
    out["word_bytes"] = float(len(data) - counts[_BLANK].sum()) / n
    out["plain"] = float(counts[_PLAIN].sum()) / len(data)
    if capitals + small >= LONG:
        out["capitals"] = capitals / (capitals + small)
    if n >= LONG:
        out["echoes"] = sum(map(operator.eq, words, islice(words, 1, None))) / n
        out["commonest"] = max(times.values()) / n
        out["sentence"] = n / (1.0 + float(counts[46] + counts[33] + counts[63]))
        out["variety"] = len(times) / n**0.7
    return out


# Per measure: good from..to, and bad below..above; between them no opinion.
LABELLERS: dict[str, tuple[float, float, float, float]] = {
    "symbols": (-1.0, 0.05, -1.0, 0.30),
    "shouts": (-1.0, 0.05, -1.0, 0.25),
    "word_bytes": (2.5, 9.0, 1.5, 14.0),
    "plain": (0.9, 1.0, 0.8, 1.0),
    "capitals": (0.0, 0.15, -1.0, 0.50),
    "echoes": (-1.0, 0.05, -1.0, 0.20),
    "commonest": (0.0, 0.15, -1.0, 0.30),
    "sentence": (3.0, 60.0, 1.2, 200.0),
    "variety": (1.5, 99.0, 1.0, 999.0),
}


def vote(value: float | None, rule: tuple[float, float, float, float]) -> int:
    """2 for good, 0 for bad, 1 for no opinion."""
    if value is None:
        return 1
    good_from, good_to, bad_below, bad_above = rule
    if value < bad_below or value > bad_above:
        return 0
    return 2 if good_from <= value <= good_to else 1


def votes_of(found: dict[str, float]) -> str:
    return "".join(str(vote(found.get(name), rule)) for name, rule in LABELLERS.items())


@dataclass
class LabelModel:
    """``chances[c, k, o]``: that labeller k, where it has one, gives opinion o (0 bad, 1 good) on class c (0 bad, 1 good)."""

    prior: float
    chances: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good per row of votes; having no opinion says nothing."""
        logs = np.log([1 - self.prior, self.prior])[:, None] + np.zeros(len(patterns))
        for k in range(patterns.shape[1]):
            has = patterns[:, k] != 1
            logs[:, has] += np.log(self.chances[:, k, patterns[has, k] // 2])
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Probability that an opinion of a labeller is right, per class (bad, good)."""
        return np.vstack([self.chances[0, :, 0], self.chances[1, :, 1]])


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = LABEL_ROUNDS) -> LabelModel:
    """Expectation-maximisation; it starts from the alarms, as each heuristic knows its own kind of bad text."""
    alarms = (patterns == 0).sum(axis=1)
    good = np.where(alarms == 0, 0.95, np.where(alarms == 1, 0.25, 0.05))
    model = LabelModel(0.5, np.full((2, patterns.shape[1], 2), 0.5))
    for _ in range(rounds):
        share = np.vstack([1 - good, good]) * counts
        # One pseudo-vote each, and one more for the right opinion.
        chances = np.stack([share @ (patterns == 0), share @ (patterns == 2)], axis=2) + 1.0
        chances[0, :, 0] += 1.0
        chances[1, :, 1] += 1.0
        chances /= chances.sum(axis=2, keepdims=True)
        sums = share.sum(axis=1) + 1.0
        model = LabelModel(float(sums[1] / sums.sum()), chances)
        good = model.posterior(patterns)
    return model


def features(data: bytes, times: Counter, found: dict[str, float], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the hashed features: square roots of counts, each kind scaled to its length."""
    shift = np.uint64(64 - SLOT_BITS)
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    parts = []
    if len(b) >= 3:
        grams = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        counts = np.bincount(((grams * GOLDEN) >> shift).astype(np.int64), minlength=1 << SLOT_BITS)
        slot = np.flatnonzero(counts)
        parts.append((slot, counts[slot], 1.0))
    if times:
        counts = np.fromiter(times.values(), dtype=np.int64, count=len(times))
        parts.append(((hashes(list(times)) >> shift).astype(np.int64), counts, WORDS_LENGTH))
    slots, values = [], []
    for slot, counts, length in parts:
        slots.append(slot)
        values.append(np.sqrt(counts) * (length / np.sqrt(counts.sum())))
    steps = [f"{k}:{np.floor(np.log2(v + 2.0**-8)):.0f}".encode() for k, v in found.items()] + [b"bias:"]
    slots.append((hashes(steps) >> shift).astype(np.int64))
    values.append(np.full(len(steps), MEASURES_LENGTH / np.sqrt(len(steps))))
    return np.concatenate(slots), np.concatenate(values)


def _seen(text: str | None) -> tuple[bytes, Counter, dict[str, float]]:
    """The bytes of a text, how often each of its words occurs, and its measures."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    times = Counter(words)
    return data, times, measures(data, words, times)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [votes_of(_seen(t.as_py())[2]) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["votes"])


def _patterns(rows: list[str]) -> np.ndarray:
    return np.array([[int(v) for v in r] for r in rows], dtype=np.int64).reshape(len(rows), len(LABELLERS))


def learn_labels(docs: DataFrame, text: str = "text") -> tuple[LabelModel, int]:
    """Label model of all documents, and their number."""
    votes = docs.select(whole_text(named(text)).alias("text")).mapInArrow(_voted, "votes string")
    # At most three to the power of the labellers.
    counted = sorted(map(tuple, votes.groupBy("votes").agg(F.count(F.lit(1))).collect()))
    counts = np.array([r[1] for r in counted], dtype=float)
    return fit_label_model(_patterns([r[0] for r in counted]), counts), int(counts.sum())


def _trained(model: LabelModel, start: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def train(table: pa.Table) -> pa.Table:
        hashes, rows = WordHashes(), []
        for t in table.sort_by([("order", "ascending"), ("text", "ascending")]).column("text").to_pylist():
            data, times, found = _seen(t)
            rows.append((*features(data, times, found, hashes), model.posterior(_patterns([votes_of(found)]))[0]))
        weights = start.copy()
        epochs = -(-VISITS // len(rows))
        for epoch in range(epochs):
            step = STEP / (1 + (COOLING - 1) * epoch / epochs)
            for slots, values, label in rows:
                score = 1.0 / (1.0 + np.exp(-np.clip(weights[slots] @ values, -40, 40)))
                weights[slots] += step * ((label - score) * values - DECAY * weights[slots])
        return pa.table({"rows": pa.array([len(rows)], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary())})

    return train


def learn_scorer(
    docs: DataFrame, model: LabelModel, n_rows: int, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS
) -> np.ndarray:
    """Weights of the linear scorer: shares of the sample are trained apart and averaged, a few times over."""
    rows = docs.select(whole_text(named(text)).alias("text"), F.xxhash64(named(key), named(text)).alias("order"))
    if n_rows > fit_rows:
        rows = rows.where(F.col("order") < int((2 * fit_rows / n_rows - 1) * 2**63))
    sample = materialise(rows)
    weights = np.zeros(1 << SLOT_BITS)
    for _ in range(ROUNDS):
        share = F.pmod(F.col("order"), F.lit(SHARES)).alias("share")
        made = sample.groupBy(share).applyInArrow(_trained(model, weights), "rows long, weights binary").collect()
        made = sorted(((r["rows"], bytes(r["weights"])) for r in made))
        if made:
            weights = sum(n * np.frombuffer(w) for n, w in made) / sum(n for n, _ in made)
    return weights


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: float = KEEP, fit_rows: int = FIT_ROWS,
    names: tuple[str, str, str, str] = ("votes", "label", "quality", "accepted"),
) -> DataFrame:
    """``docs`` with the votes, their posterior, the scorer's probability, and whether that reaches ``keep``.

    ``names`` are the new columns; columns of ``docs`` with these names are replaced.
    """
    docs = docs.drop(*names)
    ship(docs.sparkSession)
    model, n_rows = learn_labels(docs, text)
    weights = learn_scorer(docs, model, n_rows, key, text, fit_rows)
    held = docs.sparkSession.sparkContext.broadcast((model, weights.astype(np.float32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = held.value
        hashes, posterior = WordHashes(), {}
        for batch in batches:
            votes, labels, scores = [], [], []
            for t in batch.column(batch.schema.names.index(text)):
                data, times, found = _seen(t.as_py())
                v = votes_of(found)
                if v not in posterior:
                    posterior[v] = float(model.posterior(_patterns([v]))[0])
                slots, values = features(data, times, found, hashes)
                votes.append(v)
                labels.append(posterior[v])
                scores.append(float(1.0 / (1.0 + np.exp(-np.clip(weights[slots] @ values, -40, 40)))))
            more = [pa.array(votes, pa.string()), pa.array(labels, pa.float64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *more], schema=pa.schema([*batch.schema, *(pa.field(n, a.type) for n, a in zip(names, more))])
            )

    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0.0).alias(names[2])).schema
    return docs.mapInArrow(work, schema).withColumn(names[3], named(names[2]) >= keep)


def drop_rejected(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the scorer accepts."""
    names = fresh(docs, "votes", "label", "quality", "accepted")
    return score(docs, key, text, names=tuple(names), **how).where(named(names[3])).drop(*names)

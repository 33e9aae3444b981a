"""Votes, label model, training and scores against plain Python."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents
from varve.llm import quality
from varve.llm.words import GOLDEN, WordHashes

ODD = [
    None, "", " \n", "word", "A plain sentence of a few words, and then some more of them. " * 3, "BUY NOW!!! " * 20,
    "x " * 400, "#$%& <a> [b] {c} " * 12, "one two three four five six seven eight nine ten " * 30, "É à ü " * 30,
    "averyveryveryverylongwordwithoutanyend" * 4, "a b c d e f g h i j k l m n o p q r s t u v w x y z",
]


def measured(text):
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    n, out = len(words), {}
    if not n:
        return out
    some = lambda letters: sum(data.count(bytes([b])) for b in letters)
    symbols = b"#$%&*+<=>@[\\]^_`{|}~"
    big, small = some(range(65, 91)), some(range(97, 123))
    out["symbols"], out["shouts"] = some(symbols) / n, data.count(b"!") / n
    out["word_bytes"] = sum(map(len, words)) / n
    out["plain"] = sum(b not in symbols and b != 33 for b in data) / len(data)
    if big + small >= 20:
        out["capitals"] = big / (big + small)
    if n >= 20:
        out["echoes"] = sum(a == b for a, b in zip(words, words[1:])) / n
        out["commonest"] = max(words.count(w) for w in set(words)) / n
        out["sentence"] = n / (1 + some(b".!?"))
        out["variety"] = len(set(words)) / n**0.7
    return out


def voted(text):
    found, out = measured(text), ""
    for name, (good_from, good_to, bad_below, bad_above) in quality.LABELLERS.items():
        v = found.get(name)
        if v is None:
            out += "1"
        elif v < bad_below or v > bad_above:
            out += "0"
        else:
            out += "2" if good_from <= v <= good_to else "1"
    return out


def posteriors(votes, rounds):
    """One document at a time, without patterns."""
    good = [{0: 0.95, 1: 0.25}.get(v.count("0"), 0.05) for v in votes]
    for _ in range(rounds):
        chance = {}
        for k in range(len(votes[0])):
            for c in (0, 1):
                bad_says = sum((g if c else 1 - g) for g, v in zip(good, votes) if v[k] == "0") + (2 if c == 0 else 1)
                good_says = sum((g if c else 1 - g) for g, v in zip(good, votes) if v[k] == "2") + (2 if c == 1 else 1)
                chance[c, k] = {"0": bad_says / (bad_says + good_says), "2": good_says / (bad_says + good_says)}
        prior = (sum(good) + 1) / (len(good) + 2)
        new = []
        for v in votes:
            odds = math.log(prior / (1 - prior))
            odds += sum(math.log(chance[1, k][o] / chance[0, k][o]) for k, o in enumerate(v) if o != "1")
            new.append(1 / (1 + math.exp(-odds)))
        good = new
    return good


def slots_of(text):
    """Slot and value of each feature, as a list of pairs."""
    data, shift, hashes = (text or "").encode(), 64 - quality.SLOT_BITS, WordHashes()
    grams, words, out = {}, {}, []
    for i in range(len(data) - 2):
        slot = (int.from_bytes(data[i:i + 3], "big") * int(GOLDEN)) % 2**64 >> shift
        grams[slot] = grams.get(slot, 0) + 1
    for w in data.split():
        words[w] = words.get(w, 0) + 1
    out += [(s, math.sqrt(c / sum(grams.values()))) for s, c in grams.items()]
    out += [(int(hashes([w])[0]) >> shift, 0.5 * math.sqrt(c / sum(words.values()))) for w, c in words.items()]
    steps = [f"{k}:{math.floor(math.log2(v + 1 / 256))}" for k, v in measured(text).items()] + ["bias:"]
    return out + [(int(hashes([s.encode()])[0]) >> shift, 2 / math.sqrt(len(steps))) for s in steps]


def chance(weights, slots):
    return 1 / (1 + math.exp(-max(-40, min(40, sum(weights[s] * v for s, v in slots)))))


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()
    return [r["text"] for r in rows] + ODD


def test_votes_posteriors_and_scores_equal_plain_python(spark, monkeypatch, texts):
    weights = np.random.default_rng(4).normal(0, 1, 1 << quality.SLOT_BITS).astype(np.float32)
    monkeypatch.setattr(quality, "learn_scorer", lambda *a, **k: weights)
    out = {r["doc_id"]: r for r in quality.score(documents(spark, list(enumerate(texts)))).collect()}
    votes = [voted(t) for t in texts]
    labels = posteriors(votes, quality.LABEL_ROUNDS)
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        score = chance(weights.tolist(), slots_of(t))
        assert out[i]["votes"] == votes[i]
        assert out[i]["label"] == pytest.approx(labels[i], rel=1e-6, abs=1e-12)
        assert out[i]["quality"] == pytest.approx(score, rel=1e-4, abs=1e-9)
        assert out[i]["accepted"] == (out[i]["quality"] >= quality.KEEP)


def test_training_of_a_share_equals_plain_python(monkeypatch, texts):
    monkeypatch.setattr(quality, "VISITS", 90)
    some = texts[-30:]
    patterns = np.array([[int(v) for v in voted(t)] for t in some])
    model = quality.fit_label_model(patterns, np.ones(len(some)))
    start = np.random.default_rng(1).normal(0, 0.1, 1 << quality.SLOT_BITS)
    table = pa.table({"text": pa.array(some[::-1], pa.string()), "order": pa.array(range(len(some))[::-1], pa.int64())})
    made = quality._trained(model, start)(table).to_pylist()[0]
    weights, seen = start.tolist(), [(slots_of(t), label) for t, label in zip(some, model.posterior(patterns))]
    for epoch in range(3):
        step = 0.5 / (1 + 7 * epoch / 3)
        for slots, label in seen:
            error, once = label - chance(weights, slots), {}
            # A slot that two kinds of features share keeps the change by the later one.
            for s, v in slots:
                once[s] = weights[s] + step * (error * v - 1e-5 * weights[s])
            for s, w in once.items():
                weights[s] = w
    assert made["rows"] == len(some)
    assert np.allclose(np.frombuffer(made["weights"]), weights, rtol=1e-9, atol=1e-12)

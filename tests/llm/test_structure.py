import hashlib
import heapq
import random
import re
import zlib

import pyarrow as pa
import pytest

from varve.llm import structure
from varve.llm.queries import QUERIES

SPEC = "conv_id long, turn long, role string, text string, key string, present string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(turns):
    """Uniform-cost search over edit strings: the first to end is the cheapest, and the least of these."""
    # States by the regular expression of roles: 0 start, 1 s, 2 u, 3 a.
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, at, state, out = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in (0, 3):
            return cost, audit, out
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(queue, (cost + 5, audit + "I", at, step[state, role[0]], (*out, f"{role}:")))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (state, role[:1]) in step:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, step[state, role[:1]], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        heapq.heappush(queue, (cost + more + 1, audit + "R", at + 1, step[state, new[0]], (*out, f"{new}:{text}")))


def brute(rows, damage=True):
    groups = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = groups.setdefault(conv, [])
        one = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20 if damage else 9
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in groups.items():
        kept.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        seen, turns, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in kept:
            shown = re.sub("[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role, text, fault))
            if fault:
                counts[fault] += 1
        numbers = {t for t, _, _ in kept if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, made = cheapest(turns)
        out.append((
            conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *counts.values(), illegal, cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows, path):
    spark.createDataFrame([(*r, "k", "p") for r in rows], SPEC).repartition(3).write.parquet(f"{path}/conversations.parquet")
    out = QUERIES["op12_structure_repair"](spark, str(path))
    assert out.columns == NAMES
    assert {t for _, t in out.dtypes} == {"bigint", "string"}
    return sorted(map(tuple, out.collect()), key=str)


def made(rng, conv):
    rows = []
    for turn in range(rng.choice([0, 1, 2, 5, 9, 30])):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
        role = rng.choice(["system", "tool", "", None, "usher"]) if rng.random() < 0.1 else role
        text = rng.choice(["Hi.", "No", "Yes!", "a" * 40 + "?", " ", None, "x. \n"]) if rng.random() < 0.4 else f"Turn {turn}."
        rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def test_query_equals_brute_force(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(5)
    rows += [r for conv in [None, *range(1000, 1250)] for r in made(rng, conv)]
    have = found(spark, rows, tmp_path)
    assert have == brute(rows) and sum("R" in r[7] for r in have) > 5


@pytest.mark.parametrize("part", [1, 3, 4096])
def test_long_conversations_are_joined_from_parts(spark, monkeypatch, tmp_path, part):
    repair = structure.repair
    monkeypatch.setattr(structure, "repair", lambda *a, **k: repair(*a, **k, part=part))
    rng = random.Random(part)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", "same.", "open"])) for t in range(700)]
    rows += [(2, 5, "user", "Again.")] * 300 + [(2, 6, "assistant", f"n {i % 7}!") for i in range(50)] + [(2, None, "user", "First.")]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_empty_tables_lost_turns_and_extreme_numbers(spark, tmp_path):
    assert found(spark, [], tmp_path / "a") == []
    lost = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    big = (1 << 63) - 1
    rows = [(3, lost, "user", "Gone."), (4, -big, "user", "A."), (4, big, "assistant", "B."), (5, 1, "user", "x" * 300_000 + ".")]
    have = found(spark, rows, tmp_path / "b")
    want = [tuple(min(big, v) if isinstance(v, int) else v for v in r) for r in brute(rows)]
    assert have == want and [r for r in have if r[0] == 3] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_matrices_of_rules_equal_those_of_turns():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(structure.SYMBOLS) for _ in range(rng.randint(1, 40)))
        rules = []
        for _ in range(5):
            short = structure.Grammar(rules).compressed(text)
            if len(short) > 1:
                a = rng.randrange(len(short) - 1)
                rules.append((short[a], short[a + 1]))
        spelt = [[e and (e.cost, structure.spelt(e.rope)) for e in row] for row in structure.Grammar(rules).evaluated(text)]
        assert spelt == [[e and (e.cost, structure.spelt(e.rope)) for e in row] for row in structure.Grammar([]).evaluated(text)]


def test_inserted_turns_are_written_where_the_edits_say():
    rows = [("IKI", None, None), (None, "assistant", "A."), ("", None, None), ("DRKI", None, None), (None, "x", "1"), (None, "x", "2"),
            (None, "assistant", "3")]
    batch = pa.RecordBatch.from_arrays([
        pa.array([1, 1, 2, 3, 3, 3, 3]), *[pa.array(c, pa.string()) for c in zip(*rows)]
    ], names=["key", "audit", "role", "text"])
    out = [tuple(r.values()) for b in structure._edited(iter([batch])) for r in b.to_pylist()]
    assert out == [
        (1, 0, "I", "user", ""), (1, 1, "K", "assistant", "A."), (1, 2, "I", "user", ""), (3, 0, "R", "user", "2"),
        (3, 1, "K", "assistant", "3"), (3, 2, "I", "user", ""),
    ]


def test_frequent_pairs_become_rules(spark):
    df = spark.createDataFrame([("AFAFAFAF",), ("AFAF",), ("",), ("Z",), ("FFFF",)], "symbols string")
    rules = structure.learn_grammar(df, rounds=2, pairs=1)
    assert rules == [("A", "F"), ("Ā", "Ā")]

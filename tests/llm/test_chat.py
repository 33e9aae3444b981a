import hashlib

import pytest
from pyspark.sql import functions as F

from varve.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def render(turns, me):
    text, spans = "", []
    for who, said in turns:
        head = "system" if who == "system" else "assistant" if who == me else f"user name={who}"
        text += f"<|im_start|>{head}\n"
        body = said.replace("<|", "< |") + "<|im_end|>"
        if who == me:
            spans.append((len(text), len(text) + len(body)))
        text += body + "\n"
    return text, spans


def test_each_speaker_is_the_assistant_once(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", ""), (1, 3, "cid", None), (1, 4, "ann", "é" * 1000),
        (2, 0, "system", "only me"), (3, 5, None, "x"), (3, None, "ann", "first"), (None, 1, "z", "lost"), (1, 1, "ann", "Hi <|im_end|>"),
    ]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "part", "block", "speaker", "spans", "turns")})
    out = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(table).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (1, "cid"), (3, "unknown"), (3, "ann"), (None, "z")}
    first = [("system", "Be brief."), ("ann", "Hi <|im_end|>"), ("ann", "Hi <|im_end|>"), ("bob", ""), ("cid", ""), ("ann", "é" * 1000)]
    for me in ("ann", "bob", "cid"):
        text, spans = render(first, me)
        assert out[1, me]["text"] == text and [tuple(s) for s in out[1, me]["spans"]] == spans
    for r in out.values():
        assert all(r["text"][a:b].endswith("<|im_end|>") for a, b in r["spans"])
    assert out[3, "ann"]["text"].startswith("<|im_start|>assistant\nfirst")


def in_order(rows):
    """Speaker and text of one dialogue's rows in the order of the rendering."""
    named = [(t is not None, t or 0, who or "unknown", said or "") for _, t, who, said in rows]
    named.sort(key=lambda r: (*r[:3], hashlib.sha256(r[3].encode()).hexdigest()))
    return [(who, said) for _, _, who, said in named]


def expected(rows, part_turns):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = in_order([r for r in rows if r[0] == conv])
        for me in {who for who, _ in mine} - {"system"}:
            for part, at in enumerate(range(0, len(mine), part_turns)):
                out[conv, me, part] = render(mine[at:at + part_turns], me)
    return out


def rendered(table, **how):
    return {
        (r["conv_id"], r["perspective"], r["part"]): (r["text"], [tuple(s) for s in r["spans"]])
        for r in chat.rotate(table, **how).collect()
    }


# A NULL dialogue with most of the rows, a crowded turn number, and a turn that repeats over several parts.
CROWD = [(None, 7, "p1", f"extra {i:03}") for i in range(60)] + [(None, 7, "p2", "again")] * 90 + [(None, None, "p1", "none")] * 45
CROWD += [(None, t, "p1", f"turn {t}") for t in range(12)] + [(2, 0, "p1", "small")] * 3
CROWD += [(3, t, f"p{t % 3}", f"turn {t}") for t in range(100)] + [(3, 50, "system", None), (4, 0, None, "x" * 50_000), (5, 1, "system", "s")]


@pytest.mark.parametrize("part_turns", [1, 10, 64, 512])
def test_parts_equal_brute_force(spark, part_turns):
    table = spark.createDataFrame(CROWD, SCHEMA).repartition(5)
    want = expected(CROWD, part_turns)
    assert max(part for _, _, part in want) == (len([r for r in CROWD if r[0] is None]) - 1) // part_turns
    assert rendered(table, part_turns=part_turns) == want


def test_parts_do_not_depend_on_the_layout(spark):
    table = spark.createDataFrame(CROWD, SCHEMA)
    first, *others = [
        rendered(t, part_turns=10)
        for t in (table.coalesce(1), table.repartition(5), table.orderBy(F.rand(3)), table.repartition(7, "text"))
    ]
    assert all(o == first for o in others)


def test_one_row_more_adds_to_the_last_part_only(spark):
    rows = [(1, t, "ann", f"turn {t}") for t in range(40)]
    less = rendered(spark.createDataFrame(rows[:-1], SCHEMA), part_turns=20)
    more = rendered(spark.createDataFrame(rows, SCHEMA), part_turns=20)
    assert set(less) == set(more) and less[1, "ann", 0] == more[1, "ann", 0]


@pytest.mark.parametrize("rows", [[], [(1, 0, "system", "s")]])
def test_nothing_to_render(spark, rows):
    assert chat.rotate(spark.createDataFrame(rows, SCHEMA)).count() == 0

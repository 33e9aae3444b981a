import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, fold
from varve.llm import exact_dedup

ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "alone"),
    (9, "twice"), (9, "twice"), (None, "twice"), (None, "no id"), (None, "NO ID"), (10, "x" * 200_000), (11, "X" * 200_000),
]


def expected(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[fold(text)].append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        last = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for k in keys:
            stays = k == last and left > 0
            left -= stays
            out.append((k, last, len(keys), stays, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [7, 27])
def test_marks_equal_brute_force(spark, bits):
    found = exact_dedup.mark_copies(documents(spark, ROWS), filter_bits=bits).collect()
    have = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found), key=str)
    assert have == expected(ROWS)


def test_dropping_keeps_one_row_per_text_and_all_columns(spark):
    docs = documents(spark, ROWS).withColumns({c: F.lit(1) for c in ("key", "row", "may_repeat", "spot0", "word0", "digest", "last")})
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(fold(r["text"]) for r in rows) == sorted({fold(t) for _, t in ROWS})
    assert {r["doc_id"] for r in rows} == {3, 5, 6, 7, 8, 9, 10 + 1, None}


def test_empty_table(spark):
    docs = documents(spark, [])
    assert exact_dedup.mark_copies(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def test_a_text_without_a_copy_is_flagged_only_by_a_small_filter(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(500)])
    flagged = exact_dedup.flag_possible_copies(docs, "text", "f", 27).where("f").count()
    crowded = exact_dedup.flag_possible_copies(docs, "text", "f", 7).where("f").count()
    assert flagged == 0 and crowded > 100

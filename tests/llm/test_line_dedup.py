from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents
from varve.llm import line_dedup


def brute_force(rows, min_sites):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if site is not None:
                sites[line.strip(" \t\r")].add(site)
    bad = {line for line, s in sites.items() if line and len(s) >= min_sites}
    out = []
    for key, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\r") not in bad]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [3, 10])
def test_equals_brute_force_near_the_threshold(spark, min_sites):
    rows = []
    for k in range(1, 16):  # the line "spread k" is on k sites
        rows += [(100 * k + s, f"own {k} {s}\n  spread {k}\t\n\nown again {k % 4}", f"site{s}") for s in range(k)]
    rows += [(1, None, "site1"), (2, "", "site2"), (3, "spread 15", None), (None, "spread 14\nmine", "site0"), (None, "x", "")]
    rows += [rows[0], rows[0], (7, "word " * 100_000 + "\nspread 15", "site3")]
    docs = documents(spark, rows).withColumns({c: F.lit(0) for c in ("t", "U", "mark_t", "a", "b", "site", "line", "hash", "bad_hashes", "n_lines")})
    found = line_dedup.drop_boilerplate(docs, min_sites=min_sites)
    have = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in found.collect()), key=str)
    assert have == brute_force(rows, min_sites)


def test_a_hot_key_and_a_hot_text(spark):
    rows = [(7, f"own {i}\nshared {i % 5}", f"site{i % 12}") for i in range(300)]
    rows += [(i % 3, "the same\nshared 1", f"site{i % 12}") for i in range(300)]
    found = line_dedup.drop_boilerplate(documents(spark, rows)).collect()
    have = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in found), key=str)
    assert have == brute_force(rows, 10)


def test_the_join_of_a_hot_text_is_split(spark, skewed):
    rows = [(i, "the same\nshared", f"site{i % 12}") for i in range(40_000)]
    rows += [(i, f"own {i}\nshared", f"site{i % 12}") for i in range(40_000, 60_000)]
    docs = documents(spark, rows).repartition(40)
    out = line_dedup.drop_boilerplate(docs)
    out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    assert line_dedup.drop_boilerplate(documents(spark, [])).count() == 0

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.llm import langid

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang")


def test_agrees_with_the_language_in_the_address(spark, labelled):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r["page_id"]: re.search(r"://[^/]*/([a-z]+)/", r["url"])[1] for r in pages.collect()}
    out = langid.identify(pages, labelled).collect()
    assert len(out) == len(truth)
    assert sum(r["language"] == truth[r["page_id"]] for r in out) / len(out) > 0.98
    # Also where the markup declares nothing, or always English.
    silent = pages.withColumn("html", F.regexp_replace("html", 'lang="[a-z]*"', ""))
    out = langid.identify(silent, labelled).collect()
    assert all(r["declared"] is None for r in out)
    assert sum(r["language"] == truth[r["page_id"]] for r in out) / len(out) > 0.95
    wrong = pages.withColumn("html", F.regexp_replace("html", 'lang="[a-z]*"', 'lang="en"'))
    out = langid.identify(wrong, labelled).collect()
    assert sum(r["language"] == truth[r["page_id"]] for r in out) / len(out) > 0.95


def test_evidence_other_than_text_decides_where_there_is_no_text(spark, labelled):
    german = labelled.where("lang = 'de' and length(text) > 500").limit(40).collect()
    rows = [(i, f"http://h{i % 4}.example.de/{i}", f"<html lang='de'><p>{r['text']}</p>") for i, r in enumerate(german)]
    french = labelled.where("lang = 'fr' and length(text) > 500").limit(40).collect()
    rows += [(100 + i, f"http://h{i % 4}.example.fr/{i}", f"<html lang='fr'><p>{r['text']}</p>") for i, r in enumerate(french)]
    rows += [
        (1000, "http://h1.example.de/x", None), (1001, "http://new.example.fr/x", ""), (1002, None, "<html lang='FR-ca'>"),
        (1003, "no address", None), (None, "http://h1.example.de/x", "<html lang='xx'>"), (1000, "http://h1.example.de/x", None),
        (1004, "http://H2.EXAMPLE.fr:80", "<script>der die das</script>"), (1005, "http://h1.example.de/", "<p>" + "der und die " * 50_000),
    ]
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("host", "suffix", "share", "key", "page", "site", "end")})
    out = {}
    for r in langid.identify(pages, labelled).collect():
        out.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    says = {k: {r["language"] for r in v} for k, v in out.items()}
    assert says[1000] == {"de"} and says[1001] == {"fr"} and says[1002] == {"fr"} and says[None] == {"de"} and says[1004] == {"fr"}
    assert says[1005] == {"de"} and out[1004][0]["host"] == "h2.example.fr"
    assert out[1000][0]["text_language"] is None and out[1002][0]["declared"] == "fr"
    assert all(0 < r["confidence"] <= 1 for v in out.values() for r in v)


def test_nothing_to_learn_from_or_to_judge(spark, labelled):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<html lang='es'><p>x y z")], SCHEMA)
    assert langid.identify(pages.limit(0), labelled).count() == 0
    (row,) = langid.identify(pages, labelled.limit(0)).collect()
    assert row["language"] == "es"


def brute_force(pages, texts):
    """Posteriors in plain Python: (key, text language, language, confidence) per page."""
    names = sorted(langid.LANGUAGES)
    counts = {x: np.full(1 << langid.SLOT_BITS, langid.TRIGRAM_COUNT) for x in names}
    for text, lang in texts:
        if (lang or "").lower() in counts:
            for slot in langid.trigram_slots(text or ""):
                counts[lang.lower()][slot] += 1
    logs = {x: np.log(c / c.sum()).astype(np.float32).astype(float) for x, c in counts.items()}
    rows = []
    for key, url, html in pages:
        at = re.search(r"://([^/?#]*)", url or "")
        host = re.sub(r":\d*$", "", at[1].lower()) if at else ""
        slots = langid.trigram_slots(langid.visible_text(html or ""))
        score = np.array([logs[x][slots].sum() for x in names]) * min(1.0, langid.EVIDENCE / max(1, len(slots)))
        like = np.exp(score - score.max()).clip(1e-300)
        rows.append((key, host, re.search(r"([^.]*)$", host)[1], langid.declared_language(html or ""), len(slots), like, like / like.sum()))
    total = lambda keep: sum((r[6] for r in rows if keep(r)), np.zeros(len(names)))
    top = (total(lambda r: True) + 1) / (total(lambda r: True) + 1).sum()
    table = np.full((len(names),) * 2, langid.DECLARED_COUNT) + np.eye(len(names)) * langid.DECLARED_COUNT
    for i, x in enumerate(names):
        table[i] += total(lambda r: r[3] == x)
    table /= table.sum(axis=0)
    out = []
    for key, host, suffix, declared, n, like, share in rows:
        end = total(lambda r: r[2] == suffix) + langid.STRENGTH * top
        prior = np.maximum(total(lambda r: r[1] == host) - share, 0) + langid.STRENGTH * end / end.sum()
        post = like * prior * (table[names.index(declared)] if declared in names else 1)
        post /= post.sum()
        out.append((key, names[int(share.argmax())] if n else None, names[int(post.argmax())], post.max()))
    return out


def test_equals_brute_force(spark, labelled):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").limit(60).collect()
    # Some pages declare nothing, something false or unknown, have little text, or no address.
    rows = [tuple(r) for r in pages]
    rows += [(1000 + i, u, re.sub('lang="[a-z]*"', "", h)[:400]) for i, (_, u, h) in enumerate(rows[:20])]
    rows += [(2000 + i, None if i % 2 else u, re.sub('lang="[a-z]*"', 'lang="xx"' if i % 3 else 'lang="en"', h)[:300]) for i, (_, u, h) in enumerate(rows[20:40])]
    rows += [(3000, rows[0][1], None), (3001, None, None)]
    texts = [tuple(r) for r in labelled.limit(300).collect()]
    some = spark.createDataFrame(texts, "text string, lang string")
    found = {r["page_id"]: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA).repartition(3), some).collect()}
    want = brute_force(rows, texts)
    assert len(found) == len(want) == len(rows)
    for key, text_language, language, confidence in want:
        r = found[key]
        assert (r["text_language"], r["language"]) == (text_language, language)
        assert r["confidence"] == pytest.approx(confidence, abs=2e-3)


def test_the_pages_of_a_hot_host_are_split(spark, labelled, skewed):
    rows = [(i, "http://hot.example.de/" + str(i) if i % 3 else f"http://h{i}.example.fr/", f"<p>der die das {i}") for i in range(30_000)]
    out = langid.identify(spark.createDataFrame(rows, SCHEMA).repartition(40), labelled)
    assert len(out.collect()) == len(rows)
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()

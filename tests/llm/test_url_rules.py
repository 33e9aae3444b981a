from pyspark.sql import functions as F

from varve.llm import url_rules

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("org", None, "block"), ("a.org", "/p", "allow"), ("twice.de", "/", "allow"), ("twice.de", "/", "block"), ("", "/", "block"),
    (None, "/", "block"),
]
CASES = {
    "http://x.com/": ("x.com", "/", "com/", "allow"),
    "http://x.com": ("x.com", "", None, "allow"),
    "http://x.com?q=/en/": ("x.com", "", None, "allow"),
    "https://sub.EXAMPLE.com/en/1?x#y": ("sub.example.com", "/en/1", "example.com/en/", "block"),
    "https://example.com/en/": ("example.com", "/en/", "example.com/en/", "block"),
    "https://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
    "https://a.www.example.com/en/#f": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "ftp://b.net/es/x": ("b.net", "/es/x", "net/es/", "block"),
    "ftp://b.net/fr/x": ("b.net", "/fr/x", None, "allow"),
    "x://a.org": ("a.org", "", "org", "block"),
    "x://a.org/page": ("a.org", "/page", "a.org/p", "allow"),
    "x://twice.de/": ("twice.de", "/", "twice.de/", "block"),
    "http://x.com:80/": ("x.com:80", "/", None, "allow"),
    "no address": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "://com/\nx": ("com", "/\nx", "com/", "allow"),
    "http://" + "a." * 5000 + "com/" + "p" * 5000: ("a." * 5000 + "com", "/" + "p" * 5000, "com/", "allow"),
}


def rules(spark, rows=RULES):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def test_cases_ties_and_repeated_rows(spark):
    pages = spark.createDataFrame([(i % 3, u) for i, u in enumerate([*CASES, *CASES])], "page_id long, url string")
    clash = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "k1", "end_of_host", "start_of_path", "short")})
    for table in (pages, clash):
        out = url_rules.judge(table, rules(spark)).collect()
        assert len(out) == 2 * len(CASES)
        for r in out:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["url"]]


def test_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    (row,) = url_rules.judge(pages, rules(spark, []), default="block").collect()
    assert (row["rule"], row["verdict"]) == (None, "block")
    assert url_rules.judge(pages.limit(0), rules(spark)).count() == 0

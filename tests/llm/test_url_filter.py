from pyspark.sql import Row

from tablewright.llm.url_filter import RULE_SCHEMA, judge_urls

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
URLS = [
    None,
    "",
    "no-scheme/x",
    "://",
    "http://",
    "HTTP://A.Example.ORG/es/x?y#z",
    "https://example.org/en/148.html",
    "https://badexample.org/es/",
    "https://x.org",
    "https://x.org?/a",
    "https://x.org/",
    "ftp://shop.com/fr/1",
    "ftp://shop.com/de/1",
    "ftp://com.net/de/1",
    "ftp://shop.com:80/de/1",
    "a://b://c/d?e",
    "http://ÄÖ.com/fr/é\n?x",
    "http://" + "a." * 300 + "com/fr/" + "x" * 5000,
    "https://x.org/",
]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for c in "?#":
        rest = rest.split(c)[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = [
        (len(h + p), v, h + p)
        for h, p, v in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


def test_every_url_against_every_rule(spark):
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    for limit in (8 << 20, 0):  # broadcast, and salted copies
        got = judge_urls(urls, rules, broadcast_bytes=limit).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {
            i: expected(u) for i, u in enumerate(URLS)
        }


def test_longest_rule_wins_and_block_breaks_ties(spark):
    rules = spark.createDataFrame(
        [("a.b", "/x", "allow"), ("a.b", "/x", "block"), ("b", "/xyz", "allow"), (None, "/", "block"), ("c", None, "block")],
        RULE_SCHEMA,
    )
    urls = spark.createDataFrame([("h://a.b/xyz",), ("h://c",), ("h://z/",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in judge_urls(urls, rules, default="ask").collect()}
    # Both rules have five characters; of equal length block wins.
    assert got == {"h://a.b/xyz": ("a.b/x", "block"), "h://c": ("c", "block"), "h://z/": (None, "ask")}


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    urls = spark.createDataFrame([Row(url="h://x.org/", host=7, row="r", short="s")] * 3)
    got = judge_urls(urls, rules)
    assert sorted(got.columns) == ["host", "path", "row", "rule", "short", "url", "verdict"]
    assert [(r.row, r.host, r.verdict) for r in got.collect()] == [("r", "x.org", "allow")] * 3
    assert judge_urls(urls.limit(0), rules).count() == 0
    none = judge_urls(urls, rules.limit(0)).collect()
    assert [(r.rule, r.verdict) for r in none] == [(None, "allow")] * 3

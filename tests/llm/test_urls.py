from quillspark.llm.urls import RULES, filter_urls, rules_table

SCHEMA = "page_id long, url string, host int, rule string, html string"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return (host, path, *(best or (None, "allow")))


URLS = [
    None, "", "nothing", "http://", "https://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://notexample.com/en/7", "http://com/en/", "http://x.com/en", "ftp://b.example.net/de/81", "http://example.net/de/7",
    "http://example.net?x=/de/8", "http://example.org#/es/", "http://a.b.c.org/es/1?/fr", "http://x.org://es/", "http://.com/en/a", "http://ÀÉ.com/en/ü", "http://net/de/8", "://org/es/", "http://x.com//en/", "http://" + "a." * 300 + "com/en/" + "y" * 50000,
]


def test_equals_brute_force(spark):
    rows = [(i % 7, u, 1, "c", "h") for i, u in enumerate(URLS * 2)]
    rules = rules_table(spark, RULES)
    out = filter_urls(spark.createDataFrame(rows, SCHEMA), rules, [4, 5])
    assert set(out.columns) == {"page_id", "url", "html", "host", "path", "rule", "verdict"}
    got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in out.collect())
    assert got == sorted(str((i, *brute(u))) for i, u, *_ in rows)
    assert filter_urls(spark.createDataFrame([], SCHEMA), rules, [4, 5]).collect() == []


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "http://com/en/", "a", "b", "c"), (2, None, "a", "b", "c")], "page_id long, url string, u string, best string, _u0 string")
    got = filter_urls(df, rules_table(spark, RULES), [4, 5]).orderBy("page_id").collect()
    assert [(r.page_id, r.u, r.best, r._u0, r.rule, r.verdict) for r in got] == [(1, "a", "b", "c", "com/en/", "block"), (2, "a", "b", "c", None, "allow")]

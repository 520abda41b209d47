import pytest

from larkspur.llm import url_filters as U


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x", "http://example.com/en", "http://example.com/en/", "http://a.b.www.example.com/en/q?x=/fr/",
    "https://notexample.com/en/", "http://x.net/es/a/b/c", "http://x.net/ES/a", "http://net/fr/", "http://u@x.net:80/fr/", "http://x.net/fr/#a?b", "http://x.net?/fr/", "http://é.NET/fr/ü", "http://x..com//en//", "x://y://z.com/",
    "http://a.com/" + "deep/" * 3000, "http://" + "a." * 2000 + "com/", "http://x.net/fr/\nnew line", "http://x.net/fr",
]


def test_against_plain(spark):
    rows = [(i, u, "clash", None) for i, u in enumerate(URLS)] + [(3, URLS[3], "clash", None), (None, URLS[6], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    more = (*U.RULES, ("block", "b.www.example.com", "/"), ("block", "com", "/deep/deep/"), ("allow", "x.net", "/fr/"), ("block", "a.com", "/deep/"))
    for rules in (U.RULES, more):
        got = sorted(str(tuple(r)) for r in U.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect())
        assert got == sorted(str((i, *plain(u, rules))) for i, u, *_ in rows)
    assert U.judge_urls(pages.limit(0), U.RULES).count() == 0
    assert {r.verdict for r in U.judge_urls(pages, (), default="block").collect()} == {"block"}


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = sorted(str(r) for r in U.judge_urls(pages, U.RULES).collect())
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    assert sorted(str(r) for r in U.judge_urls(pages, U.RULES).collect()) == one


def test_rules_are_checked(spark):
    for rule in (("maybe", "com", "/"), ("allow", "com", "en/"), ("allow", "com", "/en"), ("allow", "", "/")):
        with pytest.raises(ValueError):
            U.rule_table(spark, [rule])

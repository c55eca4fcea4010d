from tidemark.llm import url_rules
from tidemark.llm.queries import URL_RULES


def judged(spark, urls, rules=URL_RULES):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rows = url_rules.judge(pages, url_rules.rule_table(spark, rules)).collect()
    return {urls[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_precedence_and_edges(spark):
    got = judged(
        spark,
        [
            "http://A.Example.ORG/es/x?y#z",
            "https://example.org/en/19",
            "https://notexample.org/es/1",
            "http://example.org",
            "http://x.com/de",
            "http://x.com/de/a",
            "http://x.com/fr/a",
            "http://net/",
            "no scheme",
            None,
            "",
            "x://h?p=://q/r",
            "http://com.org/de/",
        ],
    )
    assert got["http://A.Example.ORG/es/x?y#z"] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got["https://example.org/en/19"][2:] == ("example.org/en/1", "block")
    assert got["https://notexample.org/es/1"][2:] == ("org/", "allow")
    assert got["http://example.org"] == ("example.org", "", None, "allow")
    assert got["http://x.com/de"][2:] == (None, "allow")
    assert got["http://x.com/de/a"][2:] == ("com/de/", "block")
    assert got["http://x.com/fr/a"][2:] == ("com/fr/", "allow")
    assert got["http://net/"] == ("net", "/", None, "allow")
    for odd in ("no scheme", None, ""):
        assert got[odd] == ("", "", None, "allow")
    assert got["x://h?p=://q/r"] == ("h", "", None, "allow")
    assert got["http://com.org/de/"][2:] == ("org/", "allow")


def test_repeated_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")] * 3 + [(None, "http://a.org/x")], "page_id long, url string")
    rules = url_rules.rule_table(spark, URL_RULES + URL_RULES + [("block", None, "/"), (None, "org", "/")])
    rows = url_rules.judge(pages, rules).collect()
    assert [r.rule for r in rows] == ["org/"] * 4
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    none = url_rules.rule_table(spark, [])
    assert {r.verdict for r in url_rules.judge(pages, none, default="block").collect()} == {"block"}

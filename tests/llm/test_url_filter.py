"""URL filter: parts of URLs, rules, the Bloom filter and the exact join."""

import pytest
from pyspark.sql import functions as F

from landstrata.llm import url_filter as uf

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parts(url):
    """Host and path by the words of the contract."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "http://example.org/en/2", "ftp://org/", "http://org", "http://x.org?y=/es/", "http://badexample.org/es/",
    "http://shop.com/fr/a#b", "http://shop.com/de/a", "http://com/de/", "http://shop.com/en/", "no scheme", "", None, "://", "http://", "http://ÄB.com/de/",
    "http://net.example/a://b/c", "http://h.net/p\nq/de/?z", "http://bad.net/x/", "https://www.bad.net/x?utm_source=feed#top", "http://bad.net/x?b=2&a=1", "http://bad.net/x?a=1&b=2&ref=q",
    "http://other.net/x", "http://long.net/" + "y" * 200_000, "http://example.org:80/es/", "http://a..org/", "http://.com/fr/",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(900, URLS[0]), (901, "http://bad.net/x"), (None, "http://bad.net/x")]
    return spark.createDataFrame(rows, "page_id long, url string")


def test_parts_rules_and_list(spark, pages):
    listed = spark.createDataFrame([("http://bad.net/x",), ("https://bad.net/x/?gclid=3",), ("http://bad.net/x?a=1&b=2",), (None,), ("no host",)], "u string")
    out = uf.judge(pages, uf.rule_table(spark, RULES), listed).collect()
    assert len(out) == len(URLS) + 3
    on_list = {"http://bad.net/x/", "https://www.bad.net/x?utm_source=feed#top", "http://bad.net/x", "http://bad.net/x?b=2&a=1", "http://bad.net/x?a=1&b=2&ref=q"}
    for r in out:
        assert (r.host, r.path) == parts(r.url)
        rule, verdict = ruled(*parts(r.url))
        assert (r.rule, r.verdict) == (rule, verdict or ("block" if r.url in on_list else "allow")), r.url[:80]


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    urls = spark.range(20_000).select(F.concat(F.lit("h.net/"), "id").alias("u"))
    n = uf.blocks_for(20_000)
    assert n == 1024 and uf.blocks_for(0) == 1 and uf.blocks_for(10**9) == uf.MOST_BLOCKS
    blocks = uf.filter_blocks(urls, "u", n)
    assert uf.possible(urls, "u", blocks, n).where("not __possible").count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("other.net/"), "id").alias("u"))
    assert 0 < uf.possible(others, "u", uf.filter_blocks(urls, "u", 256), 256).where("__possible").count() < 4_000
    assert uf.possible(others, "u", blocks, n).where("__possible").count() < 60


def test_full_filter_changes_no_verdict(spark):
    """With one block for 3,000 URLs every page is possible; the exact join decides."""
    pages = spark.range(6_000).select("id", F.concat(F.lit("http://h.net/"), "id").alias("url"))
    out = uf.judge(pages, uf.rule_table(spark, RULES), pages.where("id % 2 = 0").select("url"), most_blocks=1)
    assert out.where("(verdict = 'block') <> (id % 2 = 0)").count() == 0 and out.count() == 6_000


def test_empty_tables_clashing_names_and_rule_limits(spark, pages):
    none = spark.createDataFrame([], "url string")
    rules = uf.rule_table(spark, RULES)
    assert uf.judge(spark.createDataFrame([], "page_id long, url string"), rules, none).count() == 0
    assert uf.judge(pages, rules.limit(0), none).where("verdict <> 'allow' or rule is not null").count() == 0
    clash = pages.withColumns({"host": F.lit(1), "verdict": F.lit("mine"), "w0": F.lit(2), "block": F.lit(3), "n.m": F.lit(4)})
    out = uf.judge(clash, rules, none)
    assert out.columns == ["page_id", "url", "w0", "block", "n.m", "host", "path", "rule", "verdict"]
    assert out.where("verdict = 'mine'").count() == 0
    tie = uf.rule_table(spark, [("block", "org", "/"), ("allow", "org", "/")])
    assert uf.judge(pages.where("page_id = 3"), tie, none).first().verdict == "block"
    with pytest.raises(ValueError, match="at most 4"):
        uf.with_rules(pages, rules, most=4)


def test_pages_that_the_filter_stops_are_not_shuffled(spark, pages):
    listed = spark.createDataFrame([("http://bad.net/x",)], "u string")
    plan = uf.judge(pages, uf.rule_table(spark, RULES), listed)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("LogicalRDD", "") and "CartesianProduct" not in plan and "NestedLoop" not in plan

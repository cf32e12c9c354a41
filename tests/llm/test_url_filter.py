import numpy as np
from pyspark.sql import functions as F

from vigilo.llm.url_filter import ask, build, cascade, contains, judge

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_cascade_is_exact():
    pick = np.random.default_rng(1)
    for n, m in ((0, 10), (10, 0), (50, 5000), (4000, 4000), (3000, 20)):
        keys = pick.integers(0, 1 << 63, (2, n + m), dtype=np.uint64)
        levels = build((keys[0, :n], keys[1, :n]), (keys[0, n:], keys[1, n:]))
        assert contains(levels, *keys).tolist() == [True] * n + [False] * m
        if n == 50:
            assert sum(len(x.bits) for x in levels) < 5000 / 8  # less than a bit for each key of the universe


def test_shards_and_blocks(spark):
    hosts = spark.createDataFrame([(f"h{i}.example",) for i in range(3000)] + [(None,), ("h1.example",)], "host string")
    listed = hosts.where(F.col("host").endswith("7.example"))
    found = cascade(hosts, listed, "host", shard_keys=500)
    assert found.select("shard").distinct().count() >= 5
    for block in (64 << 20, 200):
        got = ask(hosts.withColumn("listed2", F.lit("mine")), "host", found, "listed", block_bytes=block).collect()
        assert len(got) == 3002 and all(r.listed == bool(r.host and r.host.endswith("7.example")) for r in got)


def test_judge(spark):
    urls = ["http://Example.ORG/es/x", "https://a.example.org/en/12?q#f", "https://a.example.org/en/2", "http://notexample.org", "http://x.com/fr/", "http://x.com/de/#/fr/", "http://com/de/1",
            "http://xcom/de/1", "http://casino.net", "ftp://casino.org/a", "no scheme", None, "", "http://", "x://h?p=/q", "http://ÄB.Com/de/\nx", "http://a://b/c"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(None, urls[0], None)] * 2, "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, RULES, lambda h: h.contains("casino")).collect()}
    assert got[0] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("a.example.org", "/en/2", "org/", "allow")
    assert got[3] == ("notexample.org", "", None, "allow")
    assert got[4] == ("x.com", "/fr/", "com/fr/", "allow")
    assert got[5] == ("x.com", "/de/", "com/de/", "block") and got[6] == ("com", "/de/1", "com/de/", "block")
    assert got[7][2:] == (None, "allow") and got[8][2:] == (None, "block") and got[9][2:] == ("org/", "allow")
    assert got[10] == got[11] == got[12] == got[13] == ("", "", None, "allow")
    assert got[14] == ("h", "", None, "allow") and got[15] == ("Äb.com", "/de/\nx", "com/de/", "block")
    assert got[16] == ("a:", "//b/c", None, "allow")
    assert got[None] == got[0] and judge(pages, RULES, lambda h: h == "x").count() == len(urls) + 2
    assert judge(pages.limit(0), RULES, lambda h: h == "x").count() == 0

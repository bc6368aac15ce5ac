"""URL filter against plain rules, and the cascade against set membership."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import queries, url_filter
from weftline.llm.queries import URL_RULES

MORE = [*URL_RULES, ("a.b", "", "block"), ("c.a.b", "/x", "allow"), ("a.b", "/xy?".rstrip("?"), "block"), ("", "/q/", "block")]


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def urls():
    rnd = random.Random(2)
    parts = ["http", "://", "a.b", "c.", ".", "net", "NET", "example.net", "example.com", "org", "/", "/en/", "/de/", "/fr/", "/x", "/xy", "/q/", "?", "#", "é", "É", ":80", " "]
    fixed = [None, "", "://", "net/", "http://", "http://net", "http://net/", "http://x.net/en/?/", "HTTP://EXAMPLE.NET/en/a", "http://a.example.com/de/", "http://notnet/", "x://y://net/", "http://net?/", "http://b.org/fr/é", "http://.net/", "http:///q/"]
    return fixed + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 8))) for _ in range(3000)]


@pytest.mark.parametrize("rules", [URL_RULES, MORE, []])
def test_equals_plain_rules(spark, rules):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(i, u, "old") for i, u in rows], "page_id long, url string, verdict string")
    got = url_filter.UrlFilter(rules).fit(pages).judge(pages).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(u, rules) for i, u in rows}


def test_long_hosts_and_clashing_names(spark):
    hosts = ["a." * 40_000 + "net", "." * 30_000 + "example.net", "a" * 100_000]
    rows = [(i, f"http://{h}/en/" + "x" * 50_000) for i, h in enumerate(hosts)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as _best", "2 as best", "3 as own", "4 as rule")
    got = {r.page_id: r for r in url_filter.UrlFilter(URL_RULES).fit(pages).judge(pages).collect()}
    for i, u in rows:
        host, path, rule, verdict = plain(u, URL_RULES)
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict, r._best, r.best, r.own) == (host, path, rule, verdict, 1, 2, 3)


def test_contradicting_rules_and_empty_table(spark):
    with pytest.raises(ValueError):
        url_filter.UrlFilter([("a", "/", "allow"), ("a", "/", "block")])
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.UrlFilter(URL_RULES).fit(empty).judge(empty).count() == 0


@pytest.mark.parametrize("listed", [1, 50, 2000])
def test_cascade_is_exact(spark, listed):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    own = universe.filter(F.substring("key", 2, 9).cast("int") % (20_000 // listed) == 0)
    cascade = url_filter.build_cascade(universe, own, 20_000)
    member = universe.select("key", cascade.holds(F.col("key")).alias("m")).filter("m").select("key")
    assert sorted(member.collect()) == sorted(own.collect())
    assert len(cascade.levels) > 1 or listed < 50


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(queries.oracle_sql()["op5_url_filter"]).fetchall()
    got = queries.queries()["op5_url_filter"](spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)

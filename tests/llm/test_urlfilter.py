"""The URL filter against plain Python, its SQL, and the Bloom filter by itself."""

import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from claimloom.llm import urlfilter
from claimloom.llm.queries import QUERIES, URL_RULES
from oracle import compare


def parts(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def ruled(host, path):
    best = None
    for says, name in URL_RULES:
        at, slash, rest = name.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith(slash + rest) and (best is None or len(name) >= len(best[1])):
            best = says, name
    return best


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/15", "http://example.org/en/2", "http://notexample.org/es/1",
    "http://org", "http://x.com/fr/1#/de/", "ftp://x.com/de/1", "http://com/de/", "http://x.com/es/", "http://x.com?/de/", "http://x.com#://org/", "a://b://c/d",
    "http://example.org/en/1", "http://bad.net/a", "http://www.bad.net:80/a/?utm_source=x", "http://bad.net/a.html#f", "http://bad.net/b", "http://É.com/de/ü",
]
LISTED = ["http://bad.net/a", "http://x.com/de/1", "http://x.org/"]


def frames(spark, urls, listed):
    pages = spark.createDataFrame([Row(page_id=i, url=u, host="h", block=1, word=2) for i, u in enumerate(urls)], "page_id long, url string, host string, block int, word int")
    table = spark.createDataFrame([(u,) for u in listed], "u string").select(urlfilter.canonical(F.col("u")))
    return pages, table


@pytest.mark.parametrize("small", [True, False])
def test_judge(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(urlfilter, "broadcast_if_small", lambda df: df)
    pages, listed = frames(spark, URLS + URLS[:6], LISTED + [None])
    rows = urlfilter.judge(pages, URL_RULES, listed).collect()
    assert len(rows) == len(URLS) + 6
    bad = {17, 18, 19}
    for r in rows:
        url = (URLS + URLS[:6])[r["page_id"]]
        host, path = parts(url)
        best = ruled(host, path)
        assert (r["host"], r["path"]) == (host, path), url
        assert r["rule"] == (best[1] if best else None), url
        assert r["verdict"] == (best[0] if best else "block" if r["page_id"] in bad else "allow"), url


def test_null_page_id_and_empty_tables(spark):
    pages, listed = frames(spark, ["http://bad.net/a"], LISTED)
    nameless = pages.withColumn("page_id", F.lit(None).cast("long"))
    assert [tuple(r) for r in urlfilter.judge(nameless, [], listed).collect()] == [(None, "bad.net", "/a", None, "block")]
    assert [r["verdict"] for r in urlfilter.judge(pages, [], listed.limit(0)).collect()] == ["allow"]
    assert urlfilter.judge(pages.limit(0), URL_RULES, listed).collect() == []


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    blocks = 20_000 * urlfilter.BITS_PER_URL // 64
    words = urlfilter.bloom(spark.range(20_000).select(F.concat(F.lit("in/"), "id").alias("listed")), blocks)
    bits = words.select(F.max(F.bit_count(urlfilter.mask(F.col("block").cast("string"))))).first()[0]
    assert bits <= urlfilter.BITS

    def passed(prefix):
        urls = spark.range(20_000).select(F.concat(F.lit(prefix), "id").alias("u"))
        hit = urls.withColumn("block", urlfilter.block(F.col("u"), blocks)).join(words, "block")
        return hit.filter(F.col("word").bitwiseAND(urlfilter.mask(F.col("u"))) == urlfilter.mask(F.col("u"))).count()

    assert passed("in/") == 20_000
    assert passed("out/") < 600


def test_query_equals_sql(spark, con, path):
    diff, rows = compare(spark, con, "op5", *QUERIES["op5_url_filter"], path)
    assert not diff and rows == 50

"""Extraction on literal pages."""

import hashlib
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from claimloom.operators import extract, frontier
from claimloom.operators.frontier import allowed_urls, article_frontier

BOX = (
    '<html lang="gu"><head><title>t</title><script>var Claim="x";</script></head><body><h1>Head &amp; line</h1>'
    "<div class='c1'><h3><b>Claim</b></h3>\n<p>પહેલો <i>દાવો</i></p><p>second&nbsp;part</p>"
    "<h4>Fact :</h4><p>no</p></div><h2>RESULT</h2><p>False</p></body></html>"
)
LABELS = (
    "<html><p><strong>Claim –</strong> दावा <a href='/x'>यहाँ</a> है<br/><strong> Fact –</strong> नहीं</p>"
    "<h3>Result:Partly False</h3></html>"
)
LD = '<script type="application/ld+json">%s</script>'


def run(spark, *pages, **kw):
    df = spark.createDataFrame(
        [(f"https://www.site{i}.org/a", p) for i, p in enumerate(pages)], "url string, html string"
    )
    rows = extract.extract_claims(df, **kw).collect()
    return sorted(rows, key=lambda r: (r["review_url"], r["claim_text"] or ""))


def test_box(spark):
    (r,) = run(spark, BOX)
    assert (r["claim_text"], r["rating"]) == ("પહેલો દાવો second part", "False")
    assert (r["review_title"], r["language"]) == ("Head & line", "gu")
    assert (r["publisher_site"], r["extraction_method"]) == ("site0.org", "html_fallback")


def test_labels(spark):
    (r,) = run(spark, LABELS, language="hi")
    assert (r["claim_text"], r["rating"], r["language"]) == ("दावा यहाँ है", "Partly False", "hi")


def test_structured_data_comes_first(spark):
    page = LD % '{"@type":"ClaimReview","claimReviewed":"from data"}' + BOX
    (r,) = run(spark, page)
    assert (r["claim_text"], r["extraction_method"]) == ("from data", "json_ld")


@pytest.mark.parametrize("bad", [
    "not json", '{"@type":"ClaimReview"}', '{"@type":"NewsArticle","claimReviewed":"x"}',
    '{"@type":"ClaimReview","claimReviewed":"  "}', "", "[]", "42", '"text"',
])
def test_unusable_structured_data_falls_back(spark, bad):
    (r,) = run(spark, LD % bad + BOX)
    assert r["extraction_method"] == "html_fallback"


def test_all_shapes_of_structured_data(spark):
    page = (
        LD % '{"@graph":[{"@type":"WebPage"},{"@type":"ClaimReview","claimReviewed":"a","url":"https://r/1",'
             '"itemReviewed":{"author":{"name":"N"},"datePublished":"2020-01-02"}}]}'
        + LD % '[{"@type":["Review","ClaimReview"],"claimReviewed":"b","author":[{"name":"P"}]}]'
        + LD % '{"@type":"ClaimReview","claimReviewed":"c","reviewRating":{"alternateName":"गलत"}}'
    )
    rows = {r["claim_text"]: r for r in run(spark, page)}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"]["claimant"], rows["a"]["claim_date"], rows["a"]["review_url"]) == ("N", "2020-01-02", "https://r/1")
    assert rows["b"]["publisher_name"] == "P" and rows["c"]["rating"] == "गलत"


def test_page_without_claim(spark):
    page = "<html><p>Claims about facts</p><p>Results of the vote</p></html>"
    assert run(spark, page) == []
    (r,) = run(spark, page, keep_empty=True)
    assert r["extraction_method"] is None and r["claim_text"] is None


def test_long_page_is_read_whole(spark):
    filler = "<p>" + "x " * 300_000 + "</p>"
    (r,) = run(spark, f"<html>{filler}{LABELS}{filler}</html>")
    assert r["claim_text"] == "दावा यहाँ है"


def test_frontier(spark):
    pages = spark.createDataFrame([
        ("https://a.org/list", '<a href="/p/1">1</a><a class="x" href=\'https://a.org/p/2?x=1&amp;y=2\'>2</a>'
                               '<a href="//b.org/p/3">3</a><a href="/p/4#top">4</a><a href="mailto:x">m</a>'),
        ("https://a.org/p/1", '<a href="/p/1">self</a>'),
    ], "url string, html string")
    got = {r["url"] for r in article_frontier(pages, "/p/").collect()}
    assert got == {"https://a.org/p/2?x=1&y=2", "https://b.org/p/3", "https://a.org/p/4"}


def test_rules_longest_prefix_wins(spark):
    urls = [f"https://A.org{p}" for p in ("/", "", "/x/1", "/x/open/1", "/tie", "/y")] + ["https://b.org/x/1"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = spark.createDataFrame(
        [("a.org", "/x/", False), ("a.org", "/x/open", True), ("a.org", "/tie", False), ("a.org", "/tie", True)],
        "host string, prefix string, allow boolean",
    )
    got = {r["url"] for r in allowed_urls(df, rules).collect()}
    assert got == set(urls) - {"https://A.org/x/1"}


def test_links_resolve_as_in_a_browser(spark):
    pages = ["https://a.org", "https://a.org/", "http://a.org/x/y?p=1/2", "https://a.org/x/y/#f", "https://a.org/x/y/z.html"]
    hrefs = ["/p", "p", "./p", "../p", "../../../p", "p/./q/../r", "//b.org/p", "https://c.org/p", "?page=2", "/p?u=../x", "a/..", "."]
    df = spark.createDataFrame([(p, h) for p in pages for h in hrefs], "page string, href string")
    out = df.withColumn("url", frontier.absolute_url(F.col("page"), F.col("href"))).collect()
    assert {(r["page"], r["href"]): r["url"] for r in out} == {(p, h): urljoin(p, h) for p in pages for h in hrefs}
    other = spark.createDataFrame([("https://a.org", h) for h in ("mailto:x@y", "javascript:go()", "tel:1")], "page string, href string")
    assert {r["url"] for r in other.select(frontier.absolute_url(F.col("page"), F.col("href")).alias("url")).collect()} == {None}


def test_rules_without_broadcast(spark, monkeypatch):
    """A host with most of the URLs, and rules too large to broadcast."""
    urls = spark.range(5000).select(F.concat(
        F.when(F.col("id") % 3 == 0, "https://b.org/p/").otherwise("https://hot.org/p/"), F.col("id")
    ).alias("url"))
    rules = spark.range(10).select(
        F.lit("hot.org").alias("host"), F.concat(F.lit("/p/"), "id").alias("prefix"), (F.col("id") % 2 == 0).alias("allow")
    )
    want = {r["url"] for r in allowed_urls(urls, rules).collect()}
    monkeypatch.setattr(frontier, "broadcast_if_small", lambda df: df)
    assert {r["url"] for r in allowed_urls(urls, rules).collect()} == want
    assert len(want) == sum(i % 3 == 0 or int(str(i)[0]) % 2 == 0 for i in range(5000))


def test_links_as_they_are_quoted(spark):
    html = """<a href="/a/o'neil-claim">x</a><a href='/a/"b"#f'>y</a><a class=n href=/a/bare>z</a><A HREF = "/a/c?d=e&amp;f">w</A>
        <a href="#top">t</a><a href="">e</a><a data-href="/no">n</a><link href="/css">"""
    pages = spark.createDataFrame([("https://h.org/list", html)], "url string, html string")
    got = {r["url"] for r in frontier.page_links(pages).collect()}
    assert got == {"https://h.org/a/o'neil-claim", 'https://h.org/a/"b"', "https://h.org/a/bare", "https://h.org/a/c?d=e&f"}


def test_an_empty_disallow_disallows_nothing(spark):
    urls = spark.createDataFrame([("https://h.org/a",), ("https://g.org/x/1",)], "url string")
    rules = spark.createDataFrame([("h.org", "", False), ("g.org", "", True), ("g.org", "/x", False), ("h.org", None, False)], "host string, prefix string, allow boolean")
    assert {r["url"] for r in allowed_urls(urls, rules).collect()} == {"https://h.org/a"}


REVIEW = '{"@type":"ClaimReview","claimReviewed":"c"}'


@pytest.mark.parametrize("block", [
    REVIEW, f"[{REVIEW}]", f'{{"@graph":[{REVIEW}]}}', f'[{{"@graph":[{REVIEW}]}}]', f'{{"@graph":{REVIEW}}}',
    f'{{"@type":"Article","review":{REVIEW}}}', f'{{"@type":"Article","review":[{REVIEW}]}}', f'{{"@graph":[{{"@type":"WebPage","mainEntity":{REVIEW}}}]}}',
    REVIEW.replace("ClaimReview\"", "https://schema.org/ClaimReview\""), REVIEW.replace('"ClaimReview"', '["Review","http://schema.org/ClaimReview"]'),
])
def test_shapes_of_claim_reviews(spark, block):
    page = f'<script type="application/ld+json">{block}</script>'
    df = spark.createDataFrame([("https://h.org/1", page)], "url string, html string")
    assert [r["claim_text"] for r in extract.extract_jsonld(df).collect()] == ["c"]


def test_other_types_are_no_claim_reviews(spark):
    page = '<script type="application/ld+json">{"@type":"NotClaimReview","claimReviewed":"c"}</script>'
    assert extract.extract_jsonld(spark.createDataFrame([("u", page)], "url string, html string")).count() == 0


def test_rules_of_a_large_host_are_looked_up(spark):
    """100,000 rules: each URL asks once per length of prefix, and the answer is that of trying all."""
    rules = spark.range(100_000).select(
        F.lit("big.org").alias("host"),
        F.concat(F.lit("/"), F.substring(F.sha2(F.col("id").cast("string"), 256), F.lit(1), (1 + F.col("id") % 6).cast("int"))).alias("prefix"),
        (F.col("id") % 3 == 0).alias("allow"),
    )
    urls = [f"https://big.org/{hashlib.sha256(str(i * 7).encode()).hexdigest()[:9]}" for i in range(300)] + ["https://big.org", "https://other.org/a"]
    table = {}
    for r in rules.collect():
        table[r["prefix"]] = table.get(r["prefix"], False) or r["allow"]
    want = set()
    for url in urls:
        path = url.removeprefix("https://big.org") if "big.org" in url else None
        fits = [p for p in table if path and path.startswith(p)]
        if not fits or table[max(fits, key=len)]:
            want.add(url)
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    out = allowed_urls(df, rules)
    assert {r["url"] for r in out.collect()} == want and 0 < len(want) < len(urls)
    assert "StartsWith" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("page,claim", [
    # Label, text and fact in boxes of their own within one box; attributes that hold tags' ends.
    ('<div class="a>b"><div data-x=\'1 > 0\'><span title="x > y"><b>Claim</b></span></div><div><div>deep <i a=">">text</i></div></div><div><b>Fact</b></div><div>f</div></div>', "deep text"),
    # A box without a fact label ends there: that of another box is not its end.
    ("<div><b>Claim</b><p>open end</p></div><div><p>other</p></div><aside><b>Fact</b><p>f</p></aside>", None),
    ("<div><b>Claim</b><p>lost</p></div><p>between</p><div><b>Claim</b><p>kept</p><b>Fact</b></div>", "kept"),
    # Neighbouring boxes, and boxes left open.
    ("<div><h3>Claim:</h3><p>side</p></div><div><h3>Fact:</h3><p>f</p></div>", "side"),
    ("<nav><ul><li>Claim<li>Fact</ul></nav><section><div><b>Claim</b></div><p>first<p>second<div>Fact</div>", "first second"),
    ("<p><strong class='x>y'><span>Claim –</span></strong> a <b>bold</b><br>b <b>Fact –</b> f</p>", "a bold b"),
    ("<div><p><strong>Claim –</strong> no end of paragraph</div><p>elsewhere</p>", "no end of paragraph"),
    ("<p><b><strong>Claim:</strong></b> one<p>two</p>", "one"),
    ("<p>Claim – is no label</p><p><em>Claim –</em> nor this</p>", None),
    ("<p title=don't><strong>Claim –</strong> quote</p>", "quote"),
])
def test_nested_and_attribute_heavy_markup(spark, page, claim):
    rows = run(spark, f"<html><body>{page}</body></html>")
    assert [r["claim_text"] for r in rows] == ([claim] if claim else [])


@pytest.mark.parametrize("piece", ["<div", "<div>", "<strong>Claim –</strong>", "<p title=\"", "<b>Claim</b><p>x", "<script>", "Claim\n<br>", "<!--", "</div>Fact<br>"])
def test_unclosed_tags_take_linear_time(spark, piece):
    def seconds(n):
        start = time.perf_counter()
        run(spark, "claim " + piece * (n // len(piece)), keep_empty=True)
        return time.perf_counter() - start
    seconds(1000)
    assert seconds(800_000) < 20

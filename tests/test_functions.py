"""Column functions on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.functions import claims, html, text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("sample, tokens, chars, script", [
    ("यह दावा झूठा है कि मंत्री ने कहा", 8, 32, "Devanagari"),
    ("સાથે આ દાવો ખોટો છે", 5, 19, "Gujarati"),
    ("हा दावा खोटा आहे क्षत्रिय", 5, 25, "Devanagari"),
    ("This claim is FALSE 2021", 5, 24, "Latin"),
    ("क्‍ष", 1, 4, "Devanagari"),
    ("2021 42", 2, 7, "Other"),
    ("  ", 0, 2, "Other"),
    ("ab કખ", 2, 5, "Gujarati"),
    ("", 0, 0, "Other"),
])
def test_indic_text(spark, sample, tokens, chars, script):
    assert len(one(spark, text.tokenize("t"), t=sample)) == tokens
    assert one(spark, text.char_len("t"), t=sample) == chars == len(sample)
    assert one(spark, text.word_len("t"), t=sample) == len(sample.split())
    assert one(spark, text.detect_script("t"), t=sample) == script


def test_tokens_keep_signs_and_order(spark):
    assert one(spark, text.tokenize("t"), t="मंत्री ने, MODI-ji कहा।") == ["मंत्री", "ने", "modi", "ji", "कहा"]


def test_sentences(spark):
    got = one(spark, text.sentence_tokens("t"), t="पहला वाक्य। Second one!\n\n...तीसरा")
    assert got == [["पहला", "वाक्य"], ["Second", "one"], ["तीसरा"]]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
@pytest.mark.parametrize("value, day", [
    ("2023-01-05T10:00:00Z", "2023-01-05"),
    ("2023-01-05T23:30:00+05:30", "2023-01-05"),
    ("2023-01-05T01:30:00+05:30", "2023-01-04"),
    ("2023-01-05T23:59:59", "2023-01-05"),
    ("2023-01-05", "2023-01-05"),
    ("05/01/2023", "2023-01-05"),
    ("January 5, 2023", "2023-01-05"),
    ("2023-13-45", None), ("2023", None), ("bad", None), ("", None), (None, None),
])
def test_dates_do_not_depend_on_the_session_zone(spark, zone, value, day):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = one(spark, claims.claim_date_parsed(F.col("t").cast("string")), t=value)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == (datetime.date.fromisoformat(day) if day else None)


@pytest.mark.parametrize("site, url, domain", [
    ("https://www.Example.org/x", None, "example.org"),
    ("example.org", None, "example.org"),
    (None, "http://user@hi.example.org:8080/a?b#c", "hi.example.org"),
    ("", "https://www.b.org", "b.org"),
    (None, None, None),
])
def test_domain(spark, site, url, domain):
    got = one(spark, claims.publisher_domain(F.col("s").cast("string"), F.col("u").cast("string")), s=site, u=url)
    assert got == domain


@pytest.mark.parametrize("value, clean", [
    (" Partly  False.", "partly false"), ("FALSE !!", "false"), ("गलत।", "गलत"), (" . ", None), (None, None),
])
def test_rating(spark, value, clean):
    assert one(spark, claims.rating_clean(F.col("t").cast("string")), t=value) == clean


@pytest.mark.parametrize("value, plain", [
    ("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&#8211;x", "–x"), ("&#xA95;&#x0A96;", "કખ"),
    ("&#;&#x;&#55296;", "&#;&#x;&#55296;"), ("1 &lt; 2&nbsp;&quot;q&quot;", '1 < 2 "q"'), ("none", "none"),
    ("&#128512; &#39;", "😀 '"), ("AT&T &#x110000;", "AT&T &#x110000;"),
])
def test_entities(spark, value, plain):
    assert one(spark, html.unescape("t"), t=value) == plain

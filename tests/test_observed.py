"""What is found in the corpus itself: site text, inflected stopwords, the cap of a growing corpus."""

import hashlib
import random

from pyspark.sql import functions as F

from claimloom.functions import html as hx
from claimloom.operators import inflections, linesketch, sitetext
from claimloom.operators.phrases import sample_lines

def host():
    return F.expr("split(url, '/')[2]")

FOOTER = "Follow us on every channel for daily checks. Our newsroom is independent of all parties!"
CLAIM = "The new bridge was built without a single permit."


def pages(spark, n=60):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) + "."
        quoted = CLAIM if i in (5, 6, 7) else "Fact check."
        foot = FOOTER if i % 2 else FOOTER.upper().replace(" ", "&nbsp;")
        rows.append((f"https://a.org/{i}", f"<html><p>{own}</p><p>{quoted}</p><div class='f'>{foot}</div></html>"))
        rows.append((f"https://b.org/{i}", f"<html><p>{own}</p><p>{FOOTER if i < 4 else 'Short foot.'}</p></html>"))
    rows += [rows[0]] * 50 + [(None, f"<p>{FOOTER}</p>"), ("https://a.org/none", None), ("https://a.org/empty", "")]
    df = spark.createDataFrame(rows, "url string, html string")
    return df.withColumn("text", hx.unescape(hx.visible_lines("html")))


def test_site_text_is_found_and_quotes_are_kept(spark):
    df = pages(spark)
    found = sitetext.site_sentences(df, host())
    got = {(r["host"], r["sentence"]): (r["pages"], r["host_pages"]) for r in sitetext.spelt(df, found, host()).collect()}
    assert got == {
        ("a.org", "follow us on every channel for daily checks"): (60, 62),
        ("a.org", "our newsroom is independent of all parties"): (60, 62),
    }
    claims = [
        (1, FOOTER, "https://a.org/x"), (2, CLAIM, "https://a.org/x"), (3, f"{CLAIM} {FOOTER}", "https://a.org/x"),
        (4, FOOTER, "https://b.org/x"), (5, None, "https://a.org/x"), (6, "", "https://a.org/x"), (7, "...", "https://a.org/x"),
        (8, FOOTER, None), (9, "No! Follow us on every channel, for daily checks.", "https://a.org/x"), (9, FOOTER, "https://a.org/x"),
    ]
    rows = spark.createDataFrame(claims, "host long, claim_text string, url string")
    marked = sitetext.mark_site_text(rows, found, host()).collect()
    want = [
        (1, True, None), (2, False, CLAIM), (3, False, CLAIM), (4, False, FOOTER), (5, False, None), (6, False, ""), (7, False, "..."),
        (8, False, FOOTER), (9, False, "No!"), (9, True, None),
    ]
    order = lambda x: (x[0], x[1])
    assert sorted(((r["host"], r["is_site_text"], r["own_text"]) for r in marked), key=order) == sorted(want, key=order)


def test_site_text_of_nothing(spark):
    df = spark.createDataFrame([], "url string, text string")
    found = sitetext.site_sentences(df, host())
    assert found.collect() == []
    rows = spark.createDataFrame([("a b c d.", "https://a.org/1")], "claim_text string, url string")
    assert [tuple(r) for r in sitetext.mark_site_text(rows, found, host()).collect()] == [("a b c d.", "https://a.org/1", False, "a b c d.")]


def test_pieces_join_to_the_text(spark):
    texts = ["a. b", "...a", "a\n\nb! ", "", "no end", "।दावा। है॥"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.array_join(sitetext.pieces("t"), "")).collect()] == texts


def test_inflections_against_a_labelled_list(spark):
    nouns = [a + b for a in ("bal", "ter", "mon", "kir", "sol", "pav") for b in ("du", "ni", "gor", "lat", "mi", "shu")]
    # `ko` and `kon` end nouns; `h` ends many words, few of which are a word without it.
    words = nouns + [n + "ko" for n in nouns[:30]] + [n + "kon" for n in nouns[6:]] + [f"{a}zz{b}h" for a in "abcdefgh" for b in "ijklmnop"]
    words += ["yeh", "woh", "yehko", "wohkon", "yehkon", "apn", "apnko", "hamh", "ham", "xyehko", "yehk"]
    stop = [("hi", w) for w in ("yeh", "woh", "apn", "ham", "apnko", "absent")] + [("gu", "yeh")]
    docs = spark.createDataFrame([("hi", " ".join(words[i::7]), i) for i in range(7)] * 2 + [("gu", "yeh yehko", 9), ("hi", None, 8), (None, "yehko", 7)], "lang string, text string, n int")
    table = spark.createDataFrame(stop + stop[:2], "lang string, token string")
    got = {(r["lang"], r["token"]): (r["stem"], r["suffix"]) for r in inflections.inflected_stopwords(docs, table).collect()}
    labelled = {"yehko": "yeh", "wohkon": "woh", "yehkon": "yeh"}
    assert got == {("hi", w): (stem, w[len(stem):]) for w, stem in labelled.items()}
    whole = {tuple(r) for r in inflections.with_inflections(table, docs).collect()}
    assert whole == set(stop) | {("hi", w) for w in labelled}


def test_inflections_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    stop = spark.createDataFrame([("hi", "a")], "lang string, token string")
    assert inflections.inflected_stopwords(docs, stop).collect() == []


def test_capped_lines_of_a_growing_corpus(spark, tmp_path):
    rng = random.Random(5)

    def lines(lang, n):
        return [(lang, f"line {rng.randrange(2000)}") for _ in range(n)]
    landings = [lines("hi", 30) + lines("gu", 5), lines("hi", 3000), lines("hi", 600) + lines("gu", 900) + lines("xx", 40), [], lines("gu", 200)]
    whole, path, kept = [], str(tmp_path / "sketches"), []
    for i, rows in enumerate(landings):
        df = spark.createDataFrame(rows, "lang string, text string")
        linesketch.add_lines(df, f"l{i}", path, 100)
        kept.append(spark.read.parquet(f"{path}/n=100/landing=l{i}").count())
        whole += rows
        got = sorted(map(tuple, linesketch.capped_lines(spark, path, 100).collect()))
        want = sorted(map(tuple, sample_lines(spark.createDataFrame(whole, "lang string, text string"), 100).collect()))
        digest = lambda x: hashlib.md5(f"{x[0]}:{x[1]}".encode()).hexdigest()
        brute = [x for lang in ("hi", "gu") for x in sorted((x for x in whole if x[0] == lang), key=digest)[:100]]
        assert got == want == sorted(brute)
    # Of the lines that later landings bring few are below the bounds.
    assert kept[1] == 100 and kept[2] <= 100 + 45 and kept[3] == 0 and kept[4] <= 45
    # Written again, a landing changes nothing.
    linesketch.add_lines(spark.createDataFrame(landings[1], "lang string, text string"), "l1", path, 100)
    assert sorted(map(tuple, linesketch.capped_lines(spark, path, 100).collect())) == got

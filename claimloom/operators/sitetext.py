"""Sentences that a site repeats over its pages, found from the pages themselves.

Footers, calls to follow and notes about the publisher stand on many pages of a host;
a claim, also one that several pages quote, stands on few. So a sentence is counted
over the distinct pages of its host, by digest.
"""

from pyspark.sql import functions as F

from claimloom.functions.text import _col, clean_text, once
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small

# A sentence or line with its end; all of them joined are the text again.
PIECE = r"[^.!?।॥\n]*[.!?।॥\n]+|[^.!?।॥\n]+"
# A sentence of the site stands on so many pages of a host, and on such a part of them (percent).
MIN_PAGES = 5
PERCENT = 10
# Shorter ones are labels and headings and are never called site text.
MIN_WORDS = 4


def pieces(col):
    return F.regexp_extract_all(_col(col), F.lit(PIECE), F.lit(0))


def sentence_key(piece):
    """What tells sentences apart: letters and digits in lower case, single-spaced."""
    return F.trim(F.regexp_replace(F.lower(piece), r"[^\p{L}\p{M}\p{Nd}]+", " "))


def _long(key, words):
    return F.size(F.split(key, " ")) >= words


def _keys(col, words):
    """Distinct keys of the long enough sentences of a text."""
    return F.array_distinct(F.filter(F.transform(pieces(col), sentence_key), lambda k: _long(k, words)))


def site_sentences(pages, host, page="url", text="text", min_pages=MIN_PAGES, percent=PERCENT, words=MIN_WORDS):
    """(host, digest, pages, host_pages): sentences on `percent` of the pages of a host, and on `min_pages` at least.

    `host`: a column. Pages are told apart by `page`, so one that was read twice counts once; pages without a host are
    not judged. What is shuffled is three numbers a sentence and page; what is returned has, for a host, at most
    100 / `percent` times the sentences of its mean page.
    """
    digests = F.transform(F.coalesce(_keys(text, words), F.array().cast("array<string>")), lambda k: F.xxhash64(k))
    # A null digest stands for the page itself and counts the pages.
    marked = F.concat(digests, F.array(F.lit(None).cast("long")))
    seen = pages.select(host.alias("host"), F.xxhash64(page).alias("page"), F.explode_outer(marked).alias("digest"))
    counts = seen.filter(F.col("host").isNotNull()).distinct().groupBy("host", "digest").agg(F.count(F.lit(1)).alias("pages"))
    often = stored(counts.filter(F.col("pages") >= min_pages), "often")
    hosts = often.filter(F.col("digest").isNull()).select("host", F.col("pages").alias("host_pages"))
    found = often.filter(F.col("digest").isNotNull()).join(broadcast_if_small(hosts), "host")
    return found.filter(F.col("pages") * 100 >= F.col("host_pages") * percent).select("host", "digest", "pages", "host_pages")


def spelt(pages, found, host, text="text", words=MIN_WORDS):
    """`found` with `sentence`, its key, in place of the digest. The pages are read once more."""
    keys = pages.select(host.alias("host"), F.explode_outer(_keys(text, words)).alias("sentence"))
    keys = keys.filter(F.col("sentence").isNotNull()).withColumn("digest", F.xxhash64("sentence"))
    named = keys.join(broadcast_if_small(found), ["host", "digest"]).groupBy("host", "digest").agg(
        F.min("sentence").alias("sentence"), F.first("pages").alias("pages"), F.first("host_pages").alias("host_pages"),
    )
    return named.drop("digest")


def mark_site_text(df, found, host, column="claim_text"):
    """`df` with `is_site_text`: every sentence of the text is one of its site, and `own_text`: the text without those.

    A text without sentences or host is no site text. `own_text` is the text as it was if nothing is cut, and null where nothing
    is left. One row per host of `found` is looked up, with its digests in an array.
    """
    sites = stored(found.groupBy("host").agg(F.collect_set("digest").alias("site")), "sites")
    rows = df.select(F.struct("*").alias("row"), host.alias("host"))
    read = rows.join(broadcast_if_small(sites), "host", "left")
    site = F.coalesce("site", F.array().cast("array<long>"))

    def judged(parts):
        own = F.filter(parts, lambda p: (p["key"] != "") & ~F.array_contains(site, F.xxhash64(p["key"])))
        some = F.exists(parts, lambda p: p["key"] != "")
        cut = F.exists(parts, lambda p: F.array_contains(site, F.xxhash64(p["key"])))
        return F.struct(
            F.coalesce(some & (F.size(own) == 0), F.lit(False)).alias("is_site_text"),
            F.when(cut, clean_text(F.array_join(F.transform(own, lambda p: p["piece"]), "")))
            .otherwise(F.col(f"row.{column}")).alias("own_text"),
        )

    parts = F.transform(pieces(F.col(f"row.{column}")), lambda p: F.struct(p.alias("piece"), sentence_key(p).alias("key")))
    marked = read.select("row", once(parts, judged).alias("m"))
    return marked.select("row.*", F.coalesce("m.is_site_text", F.lit(False)).alias("is_site_text"), "m.own_text")

"""URL filter: host and path rules, then a block list behind a blocked Bloom filter.

The listed URLs are made canonical and hashed into blocks of 64 bits, a few bits in
one block each. A page's URL needs one lookup of one block; most unlisted URLs end
there. The few that pass are joined exactly with the listed URLs, which removes the
false positives. Built-in expressions only.
"""

from pyspark.sql import functions as F

from claimloom.session import stored
from claimloom.sizing import broadcast_if_small, spread

#: Query parameters that do not change a page.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)"
BITS = 5
BITS_PER_URL = 16
SEEDS = (11, 23)


def after_scheme(url):
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host(url):
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url):
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url):
    """Host without `www.` and port, path without closing slash or `.html`, sorted parameters that matter."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":[0-9]*$", "")
    page = F.regexp_replace(F.regexp_replace(path(url), r"\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(after_scheme(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(bare, page, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def block(url, blocks):
    return F.pmod(F.xxhash64(F.lit(SEEDS[0]), url), F.lit(blocks))


def mask(url):
    """A word with up to BITS bits set, six bits of a second hash for each."""
    digest = F.xxhash64(F.lit(SEEDS[1]), url)
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(digest, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def bloom(listed, blocks):
    """(block, word) of the blocks that are not empty; a map-side OR comes before the shuffle."""
    return listed.groupBy(block(F.col("listed"), blocks).alias("block")).agg(F.bit_or(mask(F.col("listed"))).alias("word"))


def listed_urls(urls, listed):
    """Distinct values of the column `url` whose canonical URL is in the one-column frame `listed`.

    The filter has 16 bits per listed URL. While it is measured to be small it is
    broadcast, and only what passes it is ever shuffled; beyond that bound URLs meet
    their block in a shuffle join, whose hot partitions AQE splits.
    """
    distinct = stored(listed.toDF("listed").filter("listed != ''").distinct(), "listed")
    blocks = distinct.count() * BITS_PER_URL // 64 + 1
    words = broadcast_if_small(stored(bloom(distinct, blocks), "bloom"))
    known = urls.select("url", canonical(F.col("url")).alias("canonical")).filter("url is not null")
    tried = known.withColumn("block", block(F.col("canonical"), blocks)).join(words, "block")
    passed = tried.filter(F.col("word").bitwiseAND(mask(F.col("canonical"))) == mask(F.col("canonical")))
    passed = passed.select("url", "canonical").distinct()
    return passed.join(broadcast_if_small(distinct), F.col("canonical") == F.col("listed"), "left_semi").select("url")


def judge(pages, rules, listed, page_id="page_id", url="url"):
    """Verdict on every page, one row per row of `pages`.

    `rules`: list of (verdict, rule), rule as `host/path`; a rule fits its host and
    all subdomains where the path starts with the rule's path. The rule with the most
    code points wins, the last of the list among equals. Without a rule the verdict is
    `block` if the canonical URL is in the one-column frame `listed`, else `allow`; null and empty entries list nothing.

    Columns: page_id, host, path, rule (null without one), verdict. A null URL or
    one without `://` has an empty host and path, fits no rule and is allowed. A null
    page_id keeps its row, repeated rows give equal rows. Only the named columns are
    read. Without listed URLs only rules block; an empty table gives an empty result.
    """
    rows = spread(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    parts = rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ranked = sorted(enumerate(rules), key=lambda x: (len(x[1][1]), x[0]))
    for _, (says, name) in ranked:  # the strongest is asked first, as the outermost
        at, slash, rest = name.partition("/")
        fits = F.concat(F.lit("."), F.col("host")).endswith(f".{at}") & F.col("path").startswith(slash + rest)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    ruled = parts.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("said"))
    unruled = ruled.filter("said is null")
    bad = broadcast_if_small(stored(listed_urls(unruled, listed), "blocked-urls")).withColumnRenamed("url", "bad")
    joined = ruled.join(bad, F.col("url") == F.col("bad"), "left")
    says = F.coalesce("said", F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", says.alias("verdict"))

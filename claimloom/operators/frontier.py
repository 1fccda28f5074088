"""Article links still to be collected, and the crawl rules that apply to them."""

from pyspark.sql import functions as F

from claimloom.functions.html import unescape
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small

# The value as it is written: in double quotes, in single ones, or bare.
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)"


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _without_dots(path):
    """Resolve `.` and `..` segments of a path that starts with a slash."""

    def step(done, part):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(
            F.concat(done, F.array(part))
        )

    start = F.array(F.lit(""))
    parts = F.aggregate(F.slice(F.split(path, "/"), 2, F.char_length(path)), start, step)
    directory = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(parts, "/"), directory)


def absolute_url(page_url, href):
    """`href` as seen from `page_url`; null for other schemes such as `mailto:`."""
    origin = F.regexp_extract(page_url, ORIGIN, 1)
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(page_url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+((?:/[^/?#]*)*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    page = F.regexp_extract(page_url, r"^([^?#]*)", 1)
    path = F.when(href.startswith("/"), href).otherwise(F.concat(folder, href))
    plain = F.regexp_extract(path, r"^([^?]*)", 1)
    query = F.regexp_extract(path, r"(\?.*)$", 1)
    dotted = plain.rlike(r"/\.{1,2}(?:/|$)")
    return (
        F.when(href.rlike(SCHEME + "//"), href)
        .when(href.rlike(SCHEME), F.lit(None))
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(dotted, F.concat(origin, _without_dots(plain), query))
        .otherwise(F.concat(origin, path))
    )


def _value(written):
    """An attribute's value without its quotes and without a fragment."""
    bare = F.when(written.rlike("^[\"']"), F.substr(written, F.lit(2), F.char_length(written) - 2)).otherwise(written)
    return F.regexp_replace(bare, "(?s)#.*$", "")


def page_links(pages):
    """Absolute links of each page."""
    links = pages.select(
        F.col("url").alias("page_url"),
        F.explode_outer(F.transform(
            F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: F.trim(unescape(_value(x)))
        )).alias("href"),
    ).filter("href != ''")
    url = absolute_url(F.col("page_url"), F.col("href"))
    return links.select("page_url", url.alias("url")).filter(F.col("url").isNotNull())


def article_frontier(pages, pattern, landed=None):
    """Distinct links that match `pattern` and whose page is not landed yet."""
    links = page_links(pages).select("url").filter(F.col("url").rlike(pattern)).distinct()
    done = (landed if landed is not None else pages).select("url")
    return links.join(done, "url", "left_anti")


def allowed_urls(urls, rules):
    """Drop URLs that robots rules (host, prefix, allow) disallow.

    The longest matching prefix wins, allow wins a tie, no match allows; a rule that
    disallows the empty prefix disallows nothing. A URL is asked for once per length that prefixes of its
    host have, by equality of host and prefix, so its work does not grow with the rules of
    the host. The aggregate is keyed by URL, so a host with most of the URLs is spread over all tasks.
    """
    host = F.lower(F.regexp_extract("url", HOST, 1))
    path = F.regexp_extract("url", PATH, 1)
    targets = urls.select("url").distinct().select(
        "url", host.alias("host"), F.when(path == "", F.lit("/")).otherwise(path).alias("path")
    )
    rule = rules.filter((F.col("prefix") != "") | F.col("allow")).groupBy(F.lower("host").alias("host"), "prefix").agg(
        F.max("allow").alias("allow"))
    rule = stored(rule.filter("host is not null and prefix is not null"), "crawl-rules")
    lengths = rule.groupBy("host").agg(F.collect_set(F.char_length("prefix")).alias("lengths"))
    asked = targets.join(broadcast_if_small(stored(lengths, "prefix-lengths")), "host", "left")
    # Lengths that the path has, and its beginnings of these lengths.
    fitting = F.filter("lengths", lambda n: n <= F.char_length("path"))
    starts = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    probes = asked.select("url", "host", F.explode_outer(starts).alias("prefix"))
    matched = probes.join(broadcast_if_small(rule), ["host", "prefix"], "left")
    # Length and verdict in one number, so that the aggregate is a plain maximum.
    strength = F.when(F.col("allow").isNotNull(), F.char_length("prefix") * 2 + F.col("allow").cast("int"))
    verdict = matched.groupBy("url").agg(F.max(strength).alias("strongest"))
    return verdict.filter(F.coalesce(F.col("strongest") % 2 == 1, F.lit(True))).select("url")

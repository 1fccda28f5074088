"""Spans of pattern matches, with built-in expressions only."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def keyed(docs, doc_id="doc_id", text="text"):
    """(doc_id, version, text): null text as empty; `version` tells rows with one id and other texts apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("version"), body.alias("text"))


def same_doc():
    """Join condition of two frames named a and b on (doc_id, version); a null id is one too."""
    return (F.col("a.version") == F.col("b.version")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))


#: Up to so many keys of documents (two numbers each) are broadcast; more are joined by a shuffle.
BROADCAST_DOCS = 500_000


def few(keys, most=None):
    """A stored table of document keys, to be broadcast if it has been counted to be within the bound."""
    return F.broadcast(keys) if keys.count() <= (BROADCAST_DOCS if most is None else most) else keys


def matches(texts, patterns):
    """(doc_id, version, kind, start, end, match) for the matches of each pattern.

    Matches are leftmost and do not overlap within a kind; start and end are code
    points, end exclusive. What splitting the text by the pattern leaves between the
    matches gives their places, by a running sum per text and kind, so a text with
    very many matches stays linear. Rows without a match take no part in the shuffle.
    `patterns`: list of (kind, pattern). The outer generators keep Catalyst from
    adding a filter on the array, which would search every text a second time.
    """
    found = F.array(*(
        F.struct(F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("all"))
        for kind, pattern in patterns
    ))
    per_kind = texts.select("doc_id", "version", "text", F.inline_outer(F.filter(found, lambda x: F.size(x["all"]) > 0))).filter("kind is not null")
    gaps = F.transform(F.split("text", F.col("pattern"), -1), lambda gap: F.char_length(gap))
    rows = per_kind.select("doc_id", "version", "kind", F.posexplode_outer(F.arrays_zip(gaps.alias("gap"), F.col("all").alias("match"))).alias("i", "m"))
    rows = rows.select("doc_id", "version", "kind", "i", "m.gap", "m.match").filter(F.col("match").isNotNull()).distinct()
    order = Window.partitionBy("doc_id", "version", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("match")).over(order)
    placed = rows.withColumn("end", end.cast("long"))
    return placed.select("doc_id", "version", "kind", (F.col("end") - F.char_length("match")).alias("start"), "end", "match")

"""Inflected stopwords, observed in a corpus instead of typed in.

A suffix is taken for an ending if it follows enough different words of the corpus,
and if most of what it ends is a word without it. A form is a stopword if it is one
of the list with such an ending behind.
"""

from pyspark.sql import functions as F

from claimloom.functions.text import tokenize
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small

# An ending has at most so many code points, the word before it at least.
MAX_SUFFIX = 3
MIN_STEM = 2
# Different words an ending has been seen behind, and their part of all words that end so (percent).
MIN_STEMS = 20
PERCENT = 50


def vocabulary(docs):
    """(lang, token): each word of each language once."""
    rows = docs.select("lang", F.explode_outer(F.array_distinct(tokenize("text"))).alias("token"))
    return rows.filter(F.col("token").isNotNull() & F.col("lang").isNotNull()).distinct()


def _cut(words, max_suffix, min_stem):
    """(lang, token, stem, suffix): each word cut before each of its last letters."""
    size = F.char_length("token")
    ends = F.filter(F.sequence(F.lit(1), F.lit(max_suffix)), lambda k: size - k >= min_stem)
    rows = words.select("lang", "token", F.explode_outer(ends).alias("k")).filter(F.col("k").isNotNull())
    return rows.selectExpr("lang", "token", "left(token, char_length(token) - k) as stem", "right(token, k) as suffix")


def endings(words, max_suffix=MAX_SUFFIX, min_stem=MIN_STEM, min_stems=MIN_STEMS, percent=PERCENT):
    """(lang, suffix, stems, words): endings of each language, with the words that end so and those that are a word without it.

    `words`: (lang, token), without repeats. A word occurs at most `max_suffix` times in the shuffle, as a stem it is one
    row; counts are summed in the map tasks, so a frequent ending makes no large partition.
    """
    known = words.select("lang", F.col("token").alias("stem"), F.lit(1).alias("is_word"))
    cut = _cut(words, max_suffix, min_stem).join(known, ["lang", "stem"], "left")
    counts = cut.groupBy("lang", "suffix").agg(F.count("is_word").alias("stems"), F.count(F.lit(1)).alias("words"))
    return counts.filter((F.col("stems") >= min_stems) & (F.col("stems") * 100 >= F.col("words") * percent))


def inflected_stopwords(docs, stopwords, max_suffix=MAX_SUFFIX, min_stem=MIN_STEM, min_stems=MIN_STEMS, percent=PERCENT):
    """(lang, token, stem, suffix, stems): forms in `docs` of the stopwords (lang, token) that the list itself lacks.

    Of several ways to cut a form the one with the longest stem is named.
    """
    words = stored(vocabulary(docs), "vocabulary")
    ends = stored(endings(words, max_suffix, min_stem, min_stems, percent), "endings")
    listed = stored(stopwords.select("lang", "token").distinct(), "listed")
    forms = _cut(words, max_suffix, min_stem)
    forms = forms.join(broadcast_if_small(listed.withColumnRenamed("token", "stem")), ["lang", "stem"], "left_semi")
    forms = forms.join(broadcast_if_small(ends), ["lang", "suffix"]).join(broadcast_if_small(listed), ["lang", "token"], "left_anti")
    best = F.max_by(F.struct("stem", "suffix", "stems"), F.char_length("stem"))
    return forms.groupBy("lang", "token").agg(best.alias("b")).select("lang", "token", "b.*")


def with_inflections(stopwords, docs, **bounds):
    """The stopwords (lang, token) and their observed forms."""
    return stopwords.select("lang", "token").union(inflected_stopwords(docs, stopwords, **bounds).select("lang", "token")).distinct()

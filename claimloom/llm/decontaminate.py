"""Benchmark decontamination by a distributed positional inverted index.

One pass over the corpus stores the postings (document, position, term) of every
term that some test item uses, with digests of the words that follow. The number of postings of a term
tells how rare it is. A window of an item is looked up by pairs of neighbouring words, the rarest
ones and so many that a proximity match holds two of them: a word that is missing breaks two pairs at most.
A posting less the term's place in the item is a diagonal: where the item would lie
in the document. The groups of diagonals that hold two pairs are intersected with the lists of all other terms of
the item, adjusted by their offsets, and runs of consecutive places are exact phrase matches.

Only built-in expressions are used. The corpus is never shuffled by term, so a
passage or word that a third of all documents share lands in no single task.
"""

import string
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.spans import few, same_doc
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small, spread

#: Words once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"([0-9A-Za-z\x{80}-\x{10FFFF}]+)"
#: Up to so many anchors are broadcast, of some 60 bytes each.
ANCHORS = 300_000
#: The posting that closes a document; no word is empty.
END = ""


def ascii_lower(column):
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    """Words of a text in their own case; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), 0), F.array().cast("array<string>"))


def item_terms(benchmark, item_id="item_id", text="text"):
    """(item, item_id, place, term, n) for each word of each item; `item` tells repeated ids apart."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text")
    ).distinct()
    listed = items.select(F.monotonically_increasing_id().alias("item"), "item_id", words(ascii_lower("text")).alias("all"))
    return stored(
        listed.select("item", "item_id", F.size("all").alias("n"), F.posexplode("all").alias("place", "term")),
        "items",
    )


def digest(word):
    """15 bits that words share which differ in case only, and some others."""
    return F.pmod(F.hash(F.lower(word)), F.lit(1 << 15)).cast("smallint")


def postings(docs, terms, reach, doc_id="doc_id", text="text"):
    """(doc_id, version, pos, term, next1, ..) of all words of `docs` in `terms`, and END behind the last word.

    `version` is a digest of the text, so that rows which share an id stay apart. `next1` ..: digests of the `reach`
    words that follow; they find all pairs of words, and some others.
    The lookup is by the lower case of all letters, which the engine has ready; the
    few words beyond ASCII are then compared with A-Z alone lower-cased.
    """
    known = terms.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit(END)))
    texts = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    listed = texts.select("doc_id", F.xxhash64("text").alias("version"), F.explode_outer(F.array(F.concat(words(F.col("text")), F.array(F.lit(END))))).alias("words"))
    own = listed.select("doc_id", "version", "words", F.explode_outer(F.array(F.transform("words", digest))).alias("digests"))
    following = [F.slice("digests", 1 + k, F.size("words")).alias(f"next{k}") for k in range(1, reach + 1)]
    tokens = own.select("doc_id", "version", F.posexplode_outer(F.arrays_zip(F.col("words").alias("word"), *following)).alias("pos", "at"))
    tokens = tokens.select("doc_id", "version", "pos", "at.*")
    same = F.when(
        F.octet_length("word") == F.char_length("word"), F.lower("word") == F.col("term")
    ).otherwise(ascii_lower("word") == F.col("term"))
    found = tokens.join(
        broadcast_if_small(known.withColumn("lower", F.lower("term"))), (F.lower("word") == F.col("lower")) & same
    )
    return found.select("doc_id", "version", "pos", "term", *(f"next{k}" for k in range(1, reach + 1)))


def anchors(index, terms, window, near, slop):
    """What windows are looked up by: distinct (term, ahead, digest, item, n, place, other, least).

    The word at `place` of the item is `term`, and that at `other` has the digest and lies `ahead` words behind it in the
    document. A window may lack `window - near` words, each of which is in two pairs of neighbours, so of its rarest
    pairs twice as many and two more hold `least` = 2 of a match; where it has fewer pairs, of its rarest words so many and one
    more hold one, as pairs with themselves. Windows that lack more in the whole corpus are left out.
    """
    counts = index.filter(F.col("term") != END).groupBy("term").agg(F.count("*").alias("seen"))
    seen = terms.join(counts, "term", "left").select("item", "place", "n", "term", F.coalesce("seen", F.lit(0)).cast("double").alias("seen"))
    item = Window.partitionBy("item").orderBy("place")
    after = [F.lead(c).over(item).alias(f"{c}2") for c in ("term", "seen")]
    span = lambda last: item.rangeBetween(0, window - 1 + last)
    word = F.struct("seen", "place", "term", F.col("place").alias("place2"), F.col("term").alias("term2"))
    pair = F.struct((F.col("seen") * F.col("seen2")).alias("seen"), "place", "term", (F.col("place") + 1).alias("place2"), "term2")
    each = seen.select("*", *after).select("*", word.alias("word"), F.when(F.col("term2").isNotNull(), pair).alias("pair"))
    size = F.least("n", F.lit(window))
    missing = size - F.least("n", F.lit(near))
    lists = each.select(
        "item", "place", "n", missing.alias("missing"), size.alias("size"),
        F.array_sort(F.collect_list("word").over(span(0))).alias("words"), F.array_sort(F.collect_list("pair").over(span(-1))).alias("pairs"),
    ).filter(F.col("place") <= F.greatest(F.col("n") - window, F.lit(0)))
    paired = F.col("size") - 1 >= 2 * F.col("missing") + 2
    rare = F.when(paired, F.slice("pairs", F.lit(1), 2 * F.col("missing") + 2)).otherwise(F.slice("words", F.lit(1), F.col("missing") + 1))
    alive = F.element_at("words", F.col("missing") + 1)["seen"] > 0
    chosen = lists.filter(alive).select("item", "n", F.when(paired, 2).otherwise(1).alias("least"), F.inline(rare)).filter("seen > 0").distinct()
    turns = []
    for shift in range(1 - slop, slop + 2):  # how many words further on the second word lies
        first, second = (("term", "place"), ("term2", "place2")) if shift >= 0 else (("term2", "place2"), ("term", "place"))
        here = chosen.filter("place != place2") if shift else chosen.filter("term = term2")
        turns.append(here.select(
            F.col(first[0]).alias("term"), F.lit(abs(shift)).alias("ahead"), digest(F.col(second[0])).alias("digest"),
            "item", "n", F.col(first[1]).alias("place"), F.col(second[1]).alias("other"), "least"))
    return reduce(DataFrame.union, turns).distinct()


def diagonals(index, terms, window, near, slop):
    """(doc_id, version, item, diagonal) in the groups of diagonals that hold the anchors of a match.

    The groups are those of `near_items`: of the diagonals within `slop` of each other, all
    are returned, also those that hold none of the anchors.
    """
    rare = broadcast_if_small(stored(anchors(index, terms, window, near, slop), "anchors"), max_rows=ANCHORS)
    ahead = [F.struct(F.lit(0).alias("ahead"), digest(F.col("term")).alias("digest"))]
    ahead += [F.struct(F.lit(k).alias("ahead"), F.col(f"next{k}").alias("digest")) for k in range(1, slop + 2)]
    seen = index.filter(F.col("term") != END).select("doc_id", "version", "pos", "term", F.inline(F.array(*ahead)))
    seen = seen.join(rare, ["term", "ahead", "digest"])
    one, two = F.col("pos") - F.col("place"), F.col("pos") + F.col("ahead") - F.col("other")
    low, high = F.greatest(one, two), F.least(one, two) + slop
    group = F.explode(F.sequence(low, high)).alias("group")
    pairs = seen.filter(low <= high).select("doc_id", "version", "item", "least", F.least("place", "other").alias("place"), group)
    key = ["doc_id", "version", "item", "group"]
    held = pairs.groupBy(*key).agg(F.sort_array(F.collect_set("place")).alias("places"), F.min("least").alias("least"))
    steps = F.zip_with(F.slice("places", F.lit(2), F.size("places")), F.slice("places", F.lit(1), F.size("places") - 1), lambda b, a: b - a)
    held = held.filter((F.col("least") == 1) | F.exists(steps, lambda step: step < window - 1))
    line = F.explode(F.sequence(F.col("group") - slop, F.col("group"))).alias("diagonal")
    return held.select("doc_id", "version", "item", line).distinct()


def matches(index, terms, window, near, slop):
    """(doc_id, version, item, item_id, n, diagonal, place, pos) of all item words found in place."""
    lines = stored(diagonals(index, terms, window, near, slop), "diagonals")
    docs = few(stored(lines.select("doc_id", "version").distinct(), "candidates"))
    there = index.select("doc_id", "version", "pos", "term").alias("a").join(docs.alias("b"), same_doc(), "left_semi")
    wanted = lines.join(broadcast_if_small(terms), "item").withColumn("pos", F.col("diagonal") + F.col("place"))
    hit = (F.col("a.pos") == F.col("b.pos")) & (F.col("a.term") == F.col("b.term"))
    return wanted.alias("a").join(there.alias("b"), same_doc() & hit, "left_semi").distinct()


def exact_hits(found, window):
    """The matched words that lie in a whole window: a run of consecutive places as long as the window."""
    line = ["doc_id", "version", "item", "diagonal"]
    runs = found.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(line).orderBy("place")))
    size = F.count("*").over(Window.partitionBy(*line, "run"))
    return runs.withColumn("size", size).filter(F.col("size") >= F.least("n", F.lit(window)))


def near_items(found, window, near, slop):
    """(doc_id, version, item, n) where `near` of `window` words match in order, up to `slop` words shifted.

    A word put in or left out moves what follows to another diagonal. Each match is
    put on all `slop + 1` groups of diagonals that hold it, so no pair of them is missed.
    """
    group = F.explode(F.sequence(F.col("diagonal"), F.col("diagonal") + slop))
    spread_out = found.select("doc_id", "version", "item", "n", "place", group.alias("group")).distinct()
    span = Window.partitionBy("doc_id", "version", "item", "group").orderBy("place").rangeBetween(-(window - 1), 0)
    enough = F.count("*").over(span) >= F.least(F.col("n"), F.lit(near))
    return spread_out.withColumn("enough", enough).filter("enough").select("doc_id", "version", "item", "n").distinct()


def decontaminate(docs, benchmark, window=10, near=8, slop=2, doc_id="doc_id", text="text", item_id="item_id", item_text="text"):
    """What each document shares with the benchmark, one row per row of `docs`.

    Columns: doc_id, version (digest of the text), n_words, n_hit (words in an
    exact match of `window` consecutive item words, or of a whole shorter item),
    items (their ids as sorted strings), n_near (items with a proximity match: `near` of `window` words, or of a shorter
    item as many or all, in order but for shifts by up to `slop` words), n_near_windows (those of `window` words or more), contaminated (n_hit > 0).

    A null or empty text has no words and no hit. A null doc_id keeps its row.
    Repeated rows give equal rows; rows that share an id but not the text are judged
    apart. Items without words are never found; a null item_id is the id ''; repeated
    item ids count once. Only the named columns are read, so other columns may have
    any name. With an empty benchmark nothing is hit; without documents there are no rows.
    """
    terms = item_terms(benchmark, item_id, item_text)
    index = stored(postings(docs, terms, slop + 1, doc_id, text), "postings")
    found = stored(matches(index, terms, window, near, slop), "matches")
    key = ["doc_id", "version"]
    hits = exact_hits(found, window).groupBy(key).agg(
        F.size(F.collect_set("pos")).cast("long").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    nears = near_items(found, window, near, slop).groupBy(key).agg(
        F.count("*").alias("n_near"), F.count_if(F.col("n") >= window).alias("n_near_windows"))
    judged = nears.withColumn("n_hit", F.lit(None).cast("long")).withColumn("items", F.lit(None).cast("array<string>"))
    judged = judged.unionByName(hits, allowMissingColumns=True).groupBy(key).agg(
        *(F.max(c).alias(c) for c in ("n_near", "n_near_windows", "n_hit", "items")))
    ends = index.filter(F.col("term") == END).select("doc_id", "version", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("b.n_hit", F.lit(0).cast("long"))
    return ends.alias("a").join(judged.alias("b"), same_doc(), "left").select(
        "a.doc_id", "a.version", "a.n_words", n_hit.alias("n_hit"),
        F.coalesce("b.items", F.array().cast("array<string>")).alias("items"),
        *(F.coalesce(f"b.{c}", F.lit(0).cast("long")).alias(c) for c in ("n_near", "n_near_windows")), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs, benchmark, window=10, **params):
    """Rows of `docs`, unchanged, without those that hold an exact match or a proximity match of a whole window.

    Items of fewer words than the window count only where they match exactly: a few common words
    stand near each other in many texts.
    """
    found = decontaminate(docs, benchmark, window=window, **params)
    bad = found.filter((F.col("n_hit") > 0) | (F.col("n_near_windows") > 0)).select("doc_id", "version").distinct()
    bad = few(stored(bad, "contaminated"))
    doc_id, text = (F.col(f"a.`{params.get(name, name)}`") for name in ("doc_id", "text"))
    return docs.alias("a").join(bad.alias("b"), (F.xxhash64(text) == F.col("b.version")) & doc_id.eqNullSafe(F.col("b.doc_id")), "left_anti")

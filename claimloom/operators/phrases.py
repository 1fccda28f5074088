"""Ranked phrases of a corpus and the query seeds made from them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions.text import pack, tokenize, unpack
from claimloom.operators.dedupe import PARTS, top_k
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small, is_small


def line_digest(*key):
    """Digest that orders lines as if at random, the same on every run."""
    return F.md5(F.concat_ws(":", *key))


def sample_lines(df, n=300_000, key="text", languages=schemas.LANGUAGES):
    """At most `n` lines per language, exact and repeatable, spread over the corpus.

    Takes the `n` lowest digests of (lang, key). The default key is the line itself, so
    the sample does not depend on files, splits or tasks; of equal lines as many are
    taken as there is room for. No task ever ranks a whole language: the language
    is cut into 16^5 digest buckets, their counts tell the bucket with the n-th line, and
    only lines up to that bucket are shuffled, each bucket ranked by itself. The input is read twice.
    """
    lines = df.filter(F.col("lang").isin(*languages)).withColumn(
        "_digest", line_digest("lang", key)
    )
    keys = lines.select("lang", F.substring("_digest", 1, 5).alias("_bucket"))
    counts = keys.groupBy("lang", "_bucket").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("lang").orderBy("_bucket"))
    edge = (
        counts.withColumn("upto", upto)
        .filter((F.col("upto") >= n) & (F.col("upto") - F.col("c") < n))
        .select("lang", "_bucket", (n - F.col("upto") + F.col("c")).alias("left"))
    )
    # One row per language of `languages`; none for a language with fewer lines.
    edge = edge.withColumnRenamed("_bucket", "_edge")
    bucket = F.substring("_digest", 1, 5)
    near = lines.withColumn("_bucket", bucket).join(F.broadcast(edge), "lang", "left")
    near = near.filter(F.col("_edge").isNull() | (F.col("_bucket") <= F.col("_edge")))
    inner = F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(True))
    ties = [F.col(c) for c in sorted(df.columns)]
    near = near.withColumn("_part", F.spark_partition_id() % PARTS)
    # A line that fills the last bucket is cut in parts first.
    for group in (["lang", "_bucket", "_part"], ["lang", "_bucket"]):
        position = F.row_number().over(Window.partitionBy(*group).orderBy("_digest", *ties))
        near = near.withColumn("_pos", position).filter(inner | (F.col("_pos") <= F.col("left")))
    return near.select(*df.columns)


def token_rows(docs, id="doc_id"):
    """One row per token: (lang, id, pos, token)."""
    rows = docs.select("lang", id, F.posexplode_outer(tokenize("text")).alias("pos", "token"))
    return rows.filter(F.col("token").isNotNull())


def stop_table(stopwords):
    table = stopwords.select("lang", "token")
    return F.broadcast(table.distinct()) if is_small(table) else table.distinct()


def drop_stopwords(rows, stopwords):
    """Token rows without those that are a stopword of their language.

    `stopwords`: (lang, token).
    """
    return rows.join(stop_table(stopwords), ["lang", "token"], "left_anti")


def _blank_stopwords(rows, stopwords, columns):
    """Null instead of a stopword in each of `columns`."""
    stop = stop_table(stopwords)
    for c in columns:
        marked = stop.select("lang", F.col("token").alias(c), F.lit(True).alias("is_stop"))
        rows = rows.join(marked, ["lang", c], "left").select(
            *(
                F.when(F.col("is_stop").isNull(), F.col(c)).alias(c) if name == c else name
                for name in rows.columns
            )
        )
    return rows


def _token_rows(tokens, longest, keep, stopwords):
    """One row (t1, t2, t3) per token: it and the two behind it, null for a stopword among the first `longest`."""
    rows = tokens.selectExpr(
        *keep,
        "inline_outer(arrays_zip(t, slice(t, 2, size(t)), slice(t, 3, size(t)))) as (t1, t2, t3)",
    ).filter("t1 is not null")
    if stopwords is not None:
        rows = _blank_stopwords(rows, stopwords, ("t1", "t2", "t3")[:longest])
    return rows


def gram_rows(tokens, ns=(1, 2, 3), keep=("lang",), stopwords=None):
    """Rows with a token array `t` → one row (n, t1, t2, t3) per 1-, 2- or 3-gram.

    A gram that holds a stopword is left out. Stopwords are looked up per token
    position, before the grams multiply the rows.
    """
    if not set(ns) <= {1, 2, 3}:
        raise ValueError("grams of one to three tokens are supported")
    rows = _token_rows(tokens, max(ns), keep, stopwords)
    none = F.lit(None).cast("string")

    def gram(n):
        parts = [F.col(f"t{i}") if i <= n else none for i in (1, 2, 3)]
        whole = F.col(f"t{n}").isNotNull()
        if n == 3:
            whole = whole & F.col("t2").isNotNull()
        struct = F.struct(F.lit(n).alias("n"), *(p.alias(f"t{i}") for i, p in enumerate(parts, 1)))
        return F.when(whole, struct)

    grams = F.array(*(gram(n) for n in sorted(ns)))
    return (
        rows.filter(F.col("t1").isNotNull())
        .select(*keep, F.explode_outer(grams).alias("g"))
        .filter(F.col("g").isNotNull())
        .select(*keep, "g.*")
    )


def _longest_rows(tokens, longest, single, keep, stopwords):
    """One row (t1, gram) per token for itself, without a gram, if `single`, and one for the longest gram of two to `longest` tokens that it begins.

    `group` is a number of the second token of the gram.
    """
    rest = ["t2"] if longest == 2 else ["t2", F.when(F.col("t2").isNotNull(), F.col("t3"))]
    most = F.struct("t1", F.pmod(F.xxhash64("t2"), F.lit(GROUPS)).alias("group"), F.concat_ws(" ", "t1", *rest).alias("gram"))
    alone = F.struct("t1", F.lit(None).cast("bigint").alias("group"), F.lit(None).cast("string").alias("gram"))
    both = [F.when(F.col("t2").isNotNull(), most)] + [alone] * single
    rows = _token_rows(tokens, longest, keep, stopwords).filter(F.col("t1").isNotNull())
    return rows.select(*keep, F.explode_outer(F.array(*both)).alias("g")).filter(F.col("g").isNotNull()).select(*keep, "g.*")


# Bytes of text whose grams are put together before any is shuffled.
PORTION_BYTES = 16 << 20
# The grams that begin with one token are dealt by their second token into so many groups, since a third of all grams may begin with few tokens.
GROUPS = 64


def ngram_counts(docs, ns=(1, 2, 3), stopwords=None):
    """Frequency of each gram per language, over whole lines.

    Lines are dealt into portions of about PORTION_BYTES. What is shuffled of a portion are its tokens with their counts, and for each
    task that counts, one text of the longest grams, in order, so that it compresses, with one byte a letter (`pack`). Grams of two tokens are counted from the longest
    ones that begin with them, which go where their first token and the group of the second say.
    """
    longest = max(ns)
    if longest == 1:
        rows = docs.select("lang", F.explode_outer(tokenize("text")).alias("token")).filter(F.col("token").isNotNull())
        rows = rows if stopwords is None else drop_stopwords(rows, stopwords)
        counts = rows.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("freq"))
        return counts.select("lang", F.lit(1).alias("n"), F.col("token").alias("phrase"), "freq")
    if not set(ns) <= {1, 2, 3}:
        raise ValueError("grams of one to three tokens are supported")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    tasks = int(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PORTION_BYTES)))
    # By what the line is and where it was read, so that copies are spread and a task that runs again deals as before.
    part = F.pmod(F.xxhash64(F.spark_partition_id(), *docs.columns), F.lit(tasks)).cast("int").alias("part")
    dealt = docs.select(part, "lang", "text").withColumn("text", pack("text")).repartitionById(tasks, "part")
    tokens = dealt.withColumn("text", unpack("text")).select("part", "lang", tokenize("text").alias("t"))
    rows = _longest_rows(tokens, longest, 1 in ns, ["part", "lang"], stopwords)
    to = F.pmod(F.xxhash64("lang", "t1", "group"), F.lit(tasks)).cast("int").alias("to")
    token = F.when(F.col("gram").isNull(), F.col("t1")).alias("token")
    # Rows are sorted by these keys: by the number that tells most apart first, by names last.
    packed = rows.select("part", "lang", to, token, "gram").groupBy("to", "part", "lang", "token").agg(
        F.count(F.lit(1)).alias("freq"), F.array_join(F.sort_array(F.collect_list("gram")), "\n").alias("grams")
    )
    placed = packed.drop("part").withColumn("grams", pack("grams")).repartitionById(tasks, "to").withColumn("grams", unpack("grams"))
    single = F.col("token").isNotNull()
    each = placed.select(
        "lang", "to", "token", F.when(single, F.col("freq")).otherwise(1).alias("freq"), F.explode_outer(F.split("grams", "\n")).alias("gram")
    )
    each = each.withColumn("pair", F.substring_index("gram", " ", 2))
    phrases = {
        1: F.when(single, F.col("token")), 2: F.when(~single, F.col("pair")), 3: F.when(~single & (F.col("pair") != F.col("gram")), F.col("gram")),
    }
    some = [F.when(phrases[n].isNotNull(), F.struct(F.lit(n).alias("n"), phrases[n].alias("phrase"))) for n in sorted(set(ns))]
    each = each.select("lang", "to", "freq", F.explode_outer(F.array(*some)).alias("g")).filter(F.col("g").isNotNull())
    counts = each.select("lang", "to", "freq", "g.*").groupBy("lang", "to", "n", "phrase").agg(F.sum("freq").alias("freq"))
    return counts.select("lang", "n", "phrase", "freq")


def top_phrases(counts, n=200, per_length=False):
    """The `n` most frequent grams per language, or per language and length."""
    by = ["lang", "n"] if per_length else ["lang"]
    return top_k(counts, by, [F.col("freq").desc(), F.col("phrase")], n)


# Buckets that the grams of a language are summed in to bound their counts.
BUCKETS = 1 << 16
# Up to so many pairs of language and bucket are broadcast, of some 30 bytes each.
MOST_BUCKETS = 1 << 19


def frequent_phrases(docs, n=200, ns=(1, 2, 3), stopwords=None, buckets=BUCKETS):
    """What `top_phrases(ngram_counts(docs, ns, stopwords), n)` returns, without shuffling every gram.

    A gram occurs at most as often as its bucket, and buckets are summed in the map tasks to no more rows than there are
    buckets. The grams of the `n` fullest buckets are counted; the n-th of them is a threshold that the n-th of all reaches.
    Only grams of buckets that reach it too are counted then. So what is shuffled are the grams of few buckets, each once;
    the tokens are written once and read by the three passes. Ties at the end are resolved as in the full ranking.
    """
    tokens = stored(docs.select("lang", tokenize("text").alias("t")), "tokens")
    grams = gram_rows(tokens, ns, ["lang"], stopwords)
    grams = grams.withColumn("bucket", F.pmod(F.xxhash64("n", "t1", "t2", "t3"), F.lit(buckets)).cast("int"))
    sums = stored(grams.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("most")), "gram-buckets")
    fullest = stored(top_k(sums, ["lang"], [F.col("most").desc(), F.col("bucket")], n, rank="_rank").select("lang", "bucket"), "full-buckets")

    def counted(picked, name):
        few = broadcast_if_small(picked, max_rows=MOST_BUCKETS)
        counts = grams.join(few, ["lang", "bucket"], "left_semi").groupBy("lang", "n", "t1", "t2", "t3").agg(F.count(F.lit(1)).alias("freq"))
        return stored(counts.select("lang", "n", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "freq"), name)

    first = counted(fullest, "counted-grams")
    # One row per language that has `n` grams in them; the others have all their grams counted.
    least = top_phrases(first, n).groupBy("lang").agg(F.count(F.lit(1)).alias("found"), F.min("freq").alias("freq"))
    least = least.select("lang", F.when(F.col("found") >= n, F.col("freq")).otherwise(0).alias("least"))
    rest = sums.join(broadcast_if_small(stored(least, "thresholds")), "lang").filter(F.col("most") >= F.col("least"))
    rest = stored(rest.select("lang", "bucket").join(fullest, ["lang", "bucket"], "left_anti"), "other-buckets")
    if rest.isEmpty():
        return top_phrases(first, n)
    return top_phrases(first.union(counted(rest, "more-counted-grams")), n)


def build_seeds(seeds, phrases, k=100):
    """Query list: given seeds and at most `k` phrases per list, each query text once.

    Columns: query, query_lang, query_langs. A text from several lists is one search: it keeps the language
    of a given seed, else of its best rank (then the first by name), and `query_langs`
    names all, comma-joined. Multi-word phrases are taken before single tokens, which are mostly function
    words. `seeds`: (query, query_lang); `phrases`: (lang, method, phrase, rank).
    """
    single = ~F.contains(F.trim("phrase"), F.lit(" "))
    picked = top_k(
        phrases.filter(F.trim("phrase") != ""),
        ["lang", "method"],
        [single, F.col("rank"), F.col("phrase")],
        k,
        rank="_pick",
    ).select(F.trim("phrase").alias("query"), F.col("lang").alias("query_lang"), F.col("_pick").alias("place"))
    both = seeds.select("query", "query_lang", F.lit(0).alias("place")).unionByName(picked)
    return both.groupBy("query").agg(
        F.min_by("query_lang", F.struct("place", "query_lang")).alias("query_lang"),
        F.array_join(F.array_sort(F.collect_set("query_lang")), ",").alias("query_langs"),
    )

"""Keyword scores after the published YAKE feature formulas, as relational work.

A sample is cut into batches and each batch is scored as one document. Sizes are
bounded by the batch, so no group grows with the corpus: more text means more
batches, spread over more tasks. Documents are placed by (lang, batch) once; terms,
their lookup and the phrases all work on that placement.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions.text import pack, sentence_tokens, unpack
from claimloom.operators.dedupe import top_k
from claimloom.operators.phrases import MOST_BUCKETS, line_digest, stop_table
from claimloom.session import stored, stored_dense
from claimloom.sizing import broadcast_if_small

ACRONYM = r"^\p{Lu}[\p{Lu}\p{Nd}]+$"
CAPITAL = r"^\p{Lu}"


def yake_batches(docs, size=1000, id="doc_id", languages=schemas.LANGUAGES):
    """Add `batch`: about `size` documents each, per language, by digest of the id."""
    kept = docs.filter(F.col("lang").isin(*languages))
    # One row per language of `languages`.
    per_lang = kept.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias("_k")
    )
    number = F.conv(F.substring(line_digest("lang", id), 1, 8), 16, 10).cast("bigint")
    return (
        kept.join(F.broadcast(per_lang), "lang")
        .withColumn("batch", F.pmod(number, F.col("_k")))
        .drop("_k")
    )


# Bytes of text that a task scores: its tokens, some 50 bytes of rows each and three phrases a token, stay in memory.
PLACED_BYTES = 4 << 20


def _placed(batches, id):
    """Whole texts by (lang, batch), in as many partitions as keep their tokens from being spilled."""
    docs = batches.select("lang", "batch", id, "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PLACED_BYTES))
    placed = docs.withColumn("text", pack("text")).repartition(int(tasks), "lang", "batch")
    return placed.withColumn("text", unpack("text"))


def _sentences(batches, id):
    """One row per sentence: (lang, batch, s), with `sent` counted over the batch."""
    # The one shuffle before the phrases are merged: whole documents, placed by batch.
    docs = _placed(batches, id).select("lang", "batch", id, sentence_tokens("text").alias("sents"))
    before = Window.partitionBy("lang", "batch").orderBy(id).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = docs.withColumn("start", F.coalesce(F.sum(F.size("sents")).over(before), F.lit(0)))
    return placed.select(
        "lang", "batch", "start", F.posexplode_outer("sents").alias("pos", "s")
    ).filter(F.col("s").isNotNull()).select(
        "lang", "batch", (F.col("start") + F.col("pos")).alias("sent"), "s"
    )


def _stop_marks(rows, stopwords, name="term"):
    """`rows` with `stop`: whether the column `name` is a stopword of its language."""
    if stopwords is None:
        return rows.withColumn("stop", F.lit(False))
    table = stop_table(stopwords).select("lang", F.col("token").alias(name), F.lit(True).alias("_stop"))
    marked = rows.join(table, ["lang", name], "left")
    return marked.withColumn("stop", F.col("_stop").isNotNull()).drop("_stop")


def _occurrences(sentences):
    """One row per token: its place in the batch, 64-bit digests of its neighbours and how it is spelt."""
    rows = sentences.withColumn("t", F.transform("s", lambda x: F.lower(x))).selectExpr(
        "lang", "batch", "sent",
        "posexplode_outer(arrays_zip(s, t, slice(t, 2, size(t)), "
        "concat(array(cast(null as string)), t))) as (pos, z)",
    ).selectExpr(
        "lang", "batch", "sent", "pos",
        "z.s as raw", "z.t as term", "z.`2` as right", "z.`3` as left",
    )
    capital = (F.col("pos") > 0) & F.col("raw").rlike(CAPITAL)
    return rows.filter(F.col("term").isNotNull()).select(
        "lang", "batch", "term", *(F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) for c in ("left", "right")),
        (F.shiftleft(F.col("sent").cast("bigint"), SENT_BITS) + F.col("pos")).alias("place"),
        F.col("raw").rlike(ACRONYM).cast("int").alias("acronym"), capital.cast("int").alias("capital"),
    )


# A token's place in a batch is one number: its sentence above these bits, its position below.
SENT_BITS = 32


def yake_terms(batches, id="doc_id", stopwords=None):
    """Features and score of each term of each batch; a lower score is better.

    The mean and deviation of the frequency are those of the terms that are no stopwords,
    if the batch has any.
    """
    return _terms(_sentences(batches, id), stopwords).drop("stop", "places")


def _terms(sentences, stopwords):
    """Features of each term of each batch, whether it is a stopword, and the places of its tokens."""
    # Lists alone, and of numbers: sets and medians cost several times as much to keep, write and merge for every term.
    # Rows are sorted by these keys: numbers tell most apart, names come last.
    lists = _occurrences(sentences).groupBy("batch", "lang", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.sum("acronym").alias("acronyms"), F.sum("capital").alias("capitals"),
        F.sort_array(F.collect_list("place")).alias("places"), F.collect_list("left").alias("left"), F.collect_list("right").alias("right"),
    )

    def sent(i):
        return F.shiftright(F.element_at("places", i.cast("int")), SENT_BITS)

    stats = lists.select(
        "lang", "batch", "term", "tf", "acronyms", "capitals", "places",
        ((sent(F.floor((F.col("tf") + 1) / 2)) + sent(F.floor(F.col("tf") / 2) + 1)) / 2).alias("median_sent"),
        F.size(F.array_distinct(F.transform("places", lambda x: F.shiftright(x, SENT_BITS)))).alias("sents"),
        F.size("left").alias("lefts"), F.size(F.array_distinct("left")).alias("distinct_lefts"),
        F.size("right").alias("rights"), F.size(F.array_distinct("right")).alias("distinct_rights"),
        sent(F.lit(-1)).alias("last_sent"),
    )
    batch = Window.partitionBy("batch", "lang")
    # Each sentence holds a token, so the last index counts the sentences.
    content = F.when(~F.col("stop"), F.col("tf"))
    spread = _stop_marks(stats, stopwords).withColumns({
        "mean_tf": F.coalesce(F.avg(content).over(batch), F.avg("tf").over(batch)),
        "sd_tf": F.coalesce(F.stddev_pop(content).over(batch), F.stddev_pop("tf").over(batch)),
        "max_tf": F.max("tf").over(batch),
        "n_sents": F.max("last_sent").over(batch) + 1,
    })

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    dispersion = ratio("distinct_lefts", "lefts") + ratio("distinct_rights", "rights")
    features = spread.withColumns({
        "f_case": F.greatest("acronyms", "capitals") / (1 + F.ln("tf")),
        "f_pos": F.ln(F.ln(3 + F.col("median_sent"))),
        "f_norm": F.col("tf") / (F.col("mean_tf") + F.col("sd_tf")),
        "f_rel": 1 + dispersion * F.col("tf") / F.col("max_tf"),
        "f_sent": F.col("sents") / F.col("n_sents"),
    })
    score = (F.col("f_rel") * F.col("f_pos")) / (
        F.col("f_case") + F.col("f_norm") / F.col("f_rel") + F.col("f_sent") / F.col("f_rel")
    )
    return features.select(
        "lang", "batch", "term", "tf",
        "f_case", "f_pos", "f_norm", "f_rel", "f_sent", score.alias("score"), "stop", "places",
    )


def yake_phrases(batches, stopwords=None, ns=(1, 2, 3), id="doc_id"):
    """Score of each candidate phrase of each batch: the product of its terms' scores over kf * (1 + their sum).

    A candidate lies within a sentence and neither begins nor ends with a stopword; one in
    the middle adds nothing to product and sum. Each term is scored with the places of its tokens,
    and the tokens are then lined up by them: every step works on the placement by (lang, batch), and
    tokens and scores never have to be joined.
    """
    if not set(ns) <= {1, 2, 3}:
        raise ValueError("phrases of one to three tokens are supported")
    terms = _terms(_sentences(batches, id), stopwords)
    scored = terms.select("lang", "batch", "term", "score", "stop", F.explode_outer("places").alias("place"))
    scored = scored.withColumn("sent", F.shiftright("place", SENT_BITS))
    line = Window.partitionBy("batch", "sent", "lang").orderBy("place")
    token = F.struct("term", "score", "stop")
    near = scored.select(
        "lang", "batch", F.col("term").alias("t1"), F.col("score").alias("s1"), F.col("stop").alias("stop1"),
        F.lead(token, 1).over(line).alias("x2"), F.lead(token, 2).over(line).alias("x3"),
    ).select(
        "lang", "batch", "t1", "s1", "stop1",
        *(F.col(f"x{i}.{c}").alias(f"{name}{i}") for i in (2, 3) for c, name in (("term", "t"), ("score", "s"), ("stop", "stop"))),
    )
    none = F.lit(None)

    def phrase(n):
        inner = F.when(~F.col("stop2"), F.col("s2")) if n == 3 else F.col("s2")
        return F.when(~F.col("stop1") & F.col(f"t{n}").isNotNull() & ~F.col(f"stop{n}"), F.struct(
            *((F.col(f"t{i}") if i <= n else none.cast("string")).alias(f"t{i}") for i in (1, 2, 3)),
            F.col("s1"), (inner if n > 1 else none.cast("double")).alias("s2"),
            (F.col("s3") if n > 2 else none.cast("double")).alias("s3"),
        ))

    rows = near.select("lang", "batch", F.explode_outer(F.array(*(phrase(n) for n in sorted(ns)))).alias("p"))
    per_phrase = rows.filter(F.col("p").isNotNull()).select("lang", "batch", "p.*").groupBy(
        "lang", "batch", "t1", "t2", "t3"
    ).agg(F.count(F.lit(1)).alias("kf"), *(F.max(f"s{i}").alias(f"s{i}") for i in (1, 2, 3)))
    product = F.col("s1") * F.coalesce("s2", F.lit(1.0)) * F.coalesce("s3", F.lit(1.0))
    total = F.col("s1") + F.coalesce("s2", F.lit(0.0)) + F.coalesce("s3", F.lit(0.0))
    return per_phrase.select(
        "lang", "batch",
        F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"),
        "kf",
        (product / (F.col("kf") * (1 + total))).alias("score"),
    )


# Buckets that the phrases of a language are dealt to, to bound their scores. Up to so many scores are merged without bounds.
BUCKETS = 1 << 15
FEW = 1 << 20


def _merged(scores, digits):
    return scores.groupBy("lang", "phrase").agg(
        F.round(F.avg("score"), digits).alias("score"), F.count(F.lit(1)).alias("batches")
    )


def merge_yake(scores, n=200, digits=8):
    """One ranked list per language: mean score over the batches of a phrase.

    Scores are rounded before ranking, since the order of a floating-point sum is
    not fixed; ties go by phrase.

    No mean is below the lowest score in the bucket of its phrase. So the phrases of the buckets with the lowest scores are merged, all
    their batches; the n-th of them is a threshold, and only buckets with a score that reaches it too are merged then. Phrases of the
    others are not shuffled. The scores are stored, since they cost far more to compute than to read; few are merged as they come.
    """
    scores = scores.select("lang", "phrase", "score")
    keyed = stored_dense(scores, "phrase-scores").withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).cast("int"))
    # A mean without scores is null and comes first.
    low = F.min(F.coalesce("score", F.lit(float("-inf"))))
    bounds = stored(keyed.groupBy("lang", "bucket").agg(low.alias("low"), F.count(F.lit(1)).alias("rows")), "score-bounds")
    if (bounds.agg(F.sum("rows")).first()[0] or 0) <= FEW:
        return top_k(_merged(scores, digits), ["lang"], [F.col("score"), F.col("phrase")], n)
    lowest = stored(top_k(bounds, ["lang"], [F.col("low"), F.col("bucket")], 4 * n, rank="_rank").select("lang", "bucket"), "low-buckets")

    def merged(picked, name):
        few = broadcast_if_small(picked.select(F.col("lang").alias("_lang"), F.col("bucket").alias("_bucket")), max_rows=MOST_BUCKETS)
        held = keyed.join(few, keyed["lang"].eqNullSafe(few["_lang"]) & (keyed["bucket"] == few["_bucket"]), "left_semi")
        return stored(_merged(held, digits), name)

    first = merged(lowest, "low-phrases")
    order = [F.col("score"), F.col("phrase")]
    # One row a language; one with fewer than `n` phrases has all its buckets merged already.
    least = top_k(first, ["lang"], order, n).groupBy(F.col("lang").alias("_lang")).agg(F.max("score").alias("most"))
    slack = F.lit(10.0 ** -digits) + F.abs("most") * 1e-9  # of rounding
    least = broadcast_if_small(stored(least.select("_lang", (F.col("most") + slack).alias("most")), "score-thresholds"))
    rest = bounds.join(least, bounds["lang"].eqNullSafe(least["_lang"])).filter(F.col("most").isNull() | (F.col("low") <= F.col("most")))
    known = lowest.select(F.col("lang").alias("_known"), F.col("bucket").alias("_bucket"))
    rest = rest.join(known, F.col("lang").eqNullSafe(F.col("_known")) & (F.col("bucket") == F.col("_bucket")), "left_anti").select("lang", "bucket")
    rest = stored(rest, "other-buckets")
    if not rest.isEmpty():
        first = first.unionByName(merged(rest, "other-phrases"))
    return top_k(first, ["lang"], order, n)

"""Corpus operators against brute force in plain Python, and their plans."""

import hashlib
import math
import random
import re
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimloom.functions.text import pack, unpack
from claimloom.operators import phrases as ph
from claimloom.operators import yake
from claimloom.plans import queries_storage, queries_text, views
from claimloom.sources import scans

DOCS = [
    (1, "hi", "यह दावा झूठा है। यह दावा BJP का है"),
    (2, "hi", "दावा झूठा है! Modi और Modi ने कहा"),
    (3, "gu", "સાથે આ દાવો ખોટો છે. આ દાવો"),
    (4, "hi", ""),
    (5, "gu", "..."),
    (6, "xx", "not a wanted language"),
]
WORD = re.compile(r"[\wऀ-ॣ०-ॿ઀-૿\u200c\u200d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, lang string, text string")


def grams(tokens, n):
    return [tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)]


@pytest.mark.parametrize("stop", [set(), {("hi", "है"), ("gu", "આ"), ("hi", "આ")}])
def test_gram_counts(spark, docs, stop):
    want = Counter()
    for _, lang, text in DOCS:
        tokens = WORD.findall(text.lower())
        for n in (1, 2, 3):
            for g in grams(tokens, n):
                if not any((lang, t) in stop for t in g):
                    want[lang, n, " ".join(g)] += 1
    table = spark.createDataFrame(sorted(stop) or [("hi", "zzz")], "lang string, token string")
    got = {(r["lang"], r["n"], r["phrase"]): r["freq"] for r in ph.ngram_counts(docs, stopwords=table).collect()}
    assert got == want


@pytest.mark.parametrize("n", [1, 7, 50, 100, 1000])
def test_sample_lines_is_exact(spark, n):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "gu").otherwise("hi").alias("lang"), F.col("id").alias("line_no"),
        F.lit("t").alias("text"),
    )
    got = defaultdict(set)
    for r in ph.sample_lines(df, n, "line_no").collect():
        got[r["lang"]].add(r["line_no"])
    for lang, ids in (("gu", range(0, 300, 3)), ("hi", [i for i in range(300) if i % 3])):
        order = sorted(ids, key=lambda i: hashlib.md5(f"{lang}:{i}".encode()).hexdigest())
        assert got[lang] == set(order[:n])


def test_sample_of_equal_lines_is_exact(spark):
    df = spark.range(5000).select(F.lit("hi").alias("lang"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    texts = ["same" if i % 3 == 0 else str(i) for i in range(5000)]
    order = sorted(texts, key=lambda t: hashlib.md5(f"hi:{t}".encode()).hexdigest())
    for n in (10, 1000, 3000, 4999, 6000):
        assert sorted(r["text"] for r in ph.sample_lines(df, n).collect()) == sorted(order[:n])


def test_sample_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "hi.txt").write_text("\n".join(f"line {i % 4000}" for i in range(9000)), encoding="utf-8")
    taken = []
    for size in ("4k", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = scans.read_corpus(spark, {"hi": str(tmp_path / "hi.txt")})
        taken.append(sorted(map(tuple, ph.sample_lines(lines, 100).collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert taken[0] == taken[1] and len(taken[0]) == 100


def test_top_phrases_limits_in_the_map_tasks(spark, path):
    top = ph.top_phrases(ph.ngram_counts(views.corpus(spark, path)))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "Python" not in plan and "Cartesian" not in plan


def test_text_is_tokenised_once(spark, path):
    plan = ph.ngram_counts(views.corpus(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def brute_yake(docs, stop=()):
    """Term scores of one batch, straight from the published formulas."""
    sents = []
    for _, _, text in sorted(docs):
        for s in re.split(r"[.!?।॥\n]+", text):
            if WORD.findall(s):
                sents.append(WORD.findall(s))
    tf, case, where, left, right = Counter(), defaultdict(Counter), defaultdict(list), defaultdict(list), defaultdict(list)
    for i, s in enumerate(sents):
        for p, raw in enumerate(s):
            t = raw.lower()
            tf[t] += 1
            where[t].append(i)
            case[t]["acronym"] += raw.isupper() and len(raw) > 1
            case[t]["capital"] += p > 0 and raw[0].isupper()
            if p:
                left[t].append(s[p - 1].lower())
            if p + 1 < len(s):
                right[t].append(s[p + 1].lower())
    content = [n for t, n in tf.items() if t not in stop]
    mean, sd, top = statistics.mean(content), statistics.pstdev(content), max(tf.values())
    out = {}
    for t, n in tf.items():
        c = max(case[t].values()) / (1 + math.log(n))
        pos = math.log(math.log(3 + statistics.median(where[t])))
        spread = sum(len(set(x)) / len(x) if x else 0 for x in (left[t], right[t]))
        rel = 1 + spread * n / top
        out[t] = rel * pos / (c + n / (mean + sd) / rel + len(set(where[t])) / len(sents) / rel)
    return out


def test_yake_terms_and_phrases(spark, docs):
    batches = docs.filter("lang <> 'xx'").withColumn("batch", F.lit(0).cast("bigint"))
    got = {(r["lang"], r["term"]): r["score"] for r in yake.yake_terms(batches).collect()}
    want = {
        (lang, t): s for lang in ("hi", "gu")
        for t, s in brute_yake([d for d in DOCS if d[1] == lang]).items()
    }
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)

    phrases = yake.yake_phrases(batches).collect()
    by = {(r["lang"], r["phrase"]): r for r in phrases}
    a, b = want["hi", "दावा"], want["hi", "झूठा"]
    assert by["hi", "दावा झूठा"]["kf"] == 2
    assert abs(by["hi", "दावा झूठा"]["score"] - a * b / (2 * (1 + a + b))) < 1e-9
    # Not across the end of a sentence.
    assert ("hi", "है यह") not in by


def test_yake_stopwords(spark, docs):
    """Content words alone make the mean; an inner stopword is passed over, one at an end rules out."""
    stop = {"है", "ने"}
    batches = docs.filter("lang = 'hi'").withColumn("batch", F.lit(0).cast("bigint"))
    table = spark.createDataFrame([("hi", t) for t in stop], "lang string, token string")
    want = brute_yake([d for d in DOCS if d[1] == "hi"], stop)
    got = {r["term"]: r["score"] for r in yake.yake_terms(batches, stopwords=table).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    by = {r["phrase"]: r for r in yake.yake_phrases(batches, table).collect()}
    a, b = want["modi"], want["कहा"]
    assert abs(by["modi ने कहा"]["score"] - a * b / (1 + a + b)) < 1e-9
    assert not {"है", "ने", "modi ने", "ने कहा", "दावा झूठा है", "झूठा है"} & by.keys()


def test_terms_keep_lists_of_numbers(spark):
    """No set or median is kept for every term; medians of even and odd counts, spellings and neighbours are as published."""
    rng = random.Random(8)
    words = ["दावा", "झूठा", "BJP", "Modi", "modi", "है", "ने", "कहा", "यह"] + [f"w{i}" for i in range(40)]
    rows = [(i, "hi", " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    batches = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("batch", F.lit(0).cast("bigint"))
    terms = yake.yake_terms(batches)
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "percentile" not in plan
    got, want = {r["term"]: r["score"] for r in terms.collect()}, brute_yake(rows)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in got)


def test_rows_are_sorted_by_numbers_before_names(spark, docs):
    """Terms, tokens in their lines, and grams on their way to the tasks that count them; no gram is translated to count its blanks."""
    batches = yake.yake_batches(docs, 10, languages=("hi", "gu"))
    plan = yake.yake_phrases(batches)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ObjectHashAggregate\(keys=\[batch#\d+L?, lang#\d+, term#", plan)
    assert re.search(r"Sort \[batch#\d+L? ASC NULLS FIRST, sent#\d+L? ASC NULLS FIRST, lang#", plan)
    plan = ph.ngram_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ObjectHashAggregate\(keys=\[to#\d+, part#\d+, lang#", plan) and "translate(gram#" not in plan


def test_batches_are_bounded_per_language(spark, path):
    rows = yake.yake_batches(views.corpus(spark, path), 10, languages=("hi", "gu", "mr", "es")).groupBy("lang", "batch").count().collect()
    per_lang = Counter(r["lang"] for r in rows)
    assert all(n > 1 for n in per_lang.values())
    assert max(r["count"] for r in rows) < 40


def test_terms_are_placed_once(spark, path):
    """Documents are shuffled by (lang, batch) and never again for the term scores."""
    b = yake.yake_batches(views.corpus(spark, path), 10, languages=("hi", "gu", "mr", "es"))
    plan = yake.yake_terms(b)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(lang" in line]
    assert sum("batch" in line for line in shuffles) == 1


def test_phrases_take_one_document_shuffle(spark, path):
    """Sentences are cut and placed once; terms, lookup and phrases stay where they are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        b = yake.yake_batches(views.corpus(spark, path), 10, languages=("hi", "gu", "mr", "es"))
        plan = yake.merge_yake(yake.yake_phrases(b))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(lang" in line and "ReusedExchange" not in line]
    assert sum("batch" in line.split("Exchange")[1] for line in shuffles) == 1
    assert not any("term" in line or " t1" in line for line in shuffles)


def test_seeds_prefer_phrases(spark):
    seeds = spark.createDataFrame([("seed", "en"), ("a b", "hi")], "query string, query_lang string")
    lists = spark.createDataFrame(
        [("hi", "m", "short", 1), ("hi", "m", "a b", 2), ("hi", "m", "c d", 3), ("gu", "m", "one", 1)],
        "lang string, method string, phrase string, rank int",
    )
    got = Counter((r["query"], r["query_lang"]) for r in ph.build_seeds(seeds, lists, 2).collect())
    assert got == Counter([("seed", "en"), ("a b", "hi"), ("c d", "hi"), ("one", "gu")])


def test_each_query_text_once(spark):
    seeds = spark.createDataFrame([("a b", "en")], "query string, query_lang string")
    lists = spark.createDataFrame(
        [("hi", "m", "a b", 1), ("mr", "m", "a b", 1), ("hi", "m", "c d", 2), ("mr", "k", "c d", 1)],
        "lang string, method string, phrase string, rank int",
    )
    got = {tuple(r) for r in ph.build_seeds(seeds, lists, 5).collect()}
    assert got == {("a b", "en", "en,hi,mr"), ("c d", "mr", "hi,mr")}


def test_large_stopword_table_gives_the_same_grams(spark, docs, monkeypatch):
    stop = spark.createDataFrame([("hi", "है"), ("gu", "આ")], "lang string, token string")
    want = Counter(map(tuple, ph.ngram_counts(docs, stopwords=stop).collect()))
    monkeypatch.setattr(ph, "is_small", lambda df: False)
    assert Counter(map(tuple, ph.ngram_counts(docs, stopwords=stop).collect())) == want


def test_frequent_phrases_equal_the_full_ranking(spark):
    """With ties at the end, fewer grams than asked for, stopwords, and buckets that hold several grams."""
    rng = random.Random(17)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(6000)]
    rows = [(("hi", "gu")[k % 2], " ".join(words[k * 15:k * 15 + 15])) for k in range(400)] + [("mr", "one two"), ("mr", None)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    stop = spark.createDataFrame([("hi", "w1"), ("gu", "w2")], "lang string, token string")
    for n, buckets in ((7, 1 << 16), (40, 97), (3, 5), (100_000, 1 << 10)):
        want = ph.top_phrases(ph.ngram_counts(docs, stopwords=stop), n)
        got = ph.frequent_phrases(docs, n, stopwords=stop, buckets=buckets)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (n, buckets)


def test_frequent_phrases_count_few_grams(spark, path, monkeypatch):
    """Of the different grams of the table less than a tenth is ever shuffled."""
    sizes, real = {}, ph.stored

    def stored(df, name):
        sizes[name] = (out := real(df, name)).count()
        return out

    monkeypatch.setattr(ph, "stored", stored)
    docs = views.corpus(spark, path)
    ph.frequent_phrases(docs, 20).collect()
    every = ph.ngram_counts(docs).count()
    assert sizes["counted-grams"] + sizes.get("more-counted-grams", 0) < every / 10


def test_tokens_are_shuffled_once_whatever_the_session_says(spark, path, monkeypatch):
    """No join meets tokens and scores, and the partitions that hold the tokens grow in number with the text."""
    monkeypatch.setattr(yake, "PLACED_BYTES", 1 << 14)
    conf = {"spark.sql.requireAllClusterKeysForCoPartition": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        b = yake.yake_batches(views.corpus(spark, path), 10, languages=("hi", "gu", "mr", "es"))
        plan = yake.yake_phrases(b)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(lang" in line and "batch" in line]
    assert len(dealt) == 1 and "SortMergeJoin" not in plan
    size = b.agg(F.sum(F.octet_length("text"))).first()[0]
    assert f", {-(-size // (1 << 14))})" in dealt[0] and size > 8 << 14


def test_grams_of_portions_and_groups_are_counted_together(spark, monkeypatch):
    """Every choice of lengths, with copies, lines without words or language, and stopwords, dealt into many portions."""
    monkeypatch.setattr(ph, "PORTION_BYTES", 1 << 9)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(3000)]
    rows = [(("hi", "gu", None)[k % 3], " ".join(words[k * 9:k * 9 + rng.randrange(9)])) for k in range(300)] + [("hi", "w1 w2 w3")] * 50 + [("mr", None)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for ns in ((1,), (2,), (3,), (1, 2), (1, 3), (2, 3), (1, 2, 3)):
        for stop in (set(), {("hi", "w1"), ("gu", "w2")}):
            table = spark.createDataFrame(sorted(stop), "lang string, token string") if stop else None
            want = Counter()
            for lang, text in rows:
                for n in ns:
                    want.update((lang, n, " ".join(g)) for g in grams((text or "").split(), n) if not any((lang, t) in stop for t in g))
            got = ph.ngram_counts(docs, ns, table).collect()
            assert Counter({(r["lang"], r["n"], r["phrase"]): r["freq"] for r in got}) == want and len(got) == len(want)


def test_counting_grams_shuffles_less_than_they_take(spark, path, tmp_path):
    """One text a counting task and portion, and no row per gram."""
    plan = ph.ngram_counts(views.corpus(spark, path))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(doc_id" not in line]
    assert len(dealt) == 2 and all("shufflepartitionidpassthrough" in line for line in dealt)
    packed = plan[plan.index(dealt[0]):plan.index(dealt[1])]
    assert "collect_list(gram" in packed


def test_merged_scores_equal_the_full_ranking(spark, monkeypatch):
    """With ties, low scores beside high ones, languages of few phrases or none, missing scores, and buckets that hold many phrases."""
    rng = random.Random(5)
    rows = [(("hi", "gu", None)[k % 3], f"p{int(rng.paretovariate(0.7))}", rng.choice([0.5, 1e-9, rng.random(), rng.random() ** 6])) for k in range(4000)]
    rows += [("mr", "one", 0.25), ("mr", "two", None), ("mr", "two", 0.5), ("gu", "none", None)]
    scores = spark.createDataFrame(rows, "lang string, phrase string, score double")
    for n, buckets in ((1, 1 << 15), (7, 1 << 15), (40, 97), (3, 5), (5000, 64)):
        monkeypatch.setattr(yake, "BUCKETS", buckets)
        monkeypatch.setattr(yake, "FEW", 1 << 20)
        want = yake.merge_yake(scores, n)
        monkeypatch.setattr(yake, "FEW", 0)
        got = yake.merge_yake(scores, n)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), (n, buckets)


def test_merging_scores_shuffles_few_phrases(spark, monkeypatch):
    """Of many phrases with other scores less than a fifth is merged."""
    sizes, real = {}, yake.stored

    def stored(df, name):
        sizes[name] = (out := real(df, name)).count()
        return out

    monkeypatch.setattr(yake, "stored", stored)
    monkeypatch.setattr(yake, "FEW", 0)
    base = F.pmod(F.xxhash64(F.col("id") % 40_000), F.lit(1_000_003)) / 1_000_003
    scores = spark.range(100_000).select(
        F.lit("hi").alias("lang"), F.concat(F.lit("p"), F.col("id") % 40_000).alias("phrase"), (base * (1 + F.col("id") % 7)).alias("score"))
    assert yake.merge_yake(scores, 20).count() == 20
    assert sizes["low-phrases"] + sizes.get("other-phrases", 0) < 40_000 / 5


def test_scores_are_computed_once(spark, docs, monkeypatch):
    """Of many scores the bounds and the means are made from one stored table."""
    plans = []

    def watched(real):
        def stored(df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df, name)

        return stored

    for name in ("stored", "stored_dense"):
        if hasattr(yake, name):
            monkeypatch.setattr(yake, name, watched(getattr(yake, name)))
    monkeypatch.setattr(yake, "FEW", 0)
    scores = yake.yake_phrases(docs.filter("lang <> 'xx'").withColumn("batch", F.lit(0).cast("bigint")))
    ranked = yake.merge_yake(scores, 3)
    plans.append(ranked._jdf.queryExecution().executedPlan().toString())
    assert ranked.count() == 6 and sum("regexp_extract_all" in plan for plan in plans) == 1


def test_packed_texts_come_back(spark):
    """Of both scripts, mixed and others, with every ASCII character, and bytes that are no text."""
    every = "".join(map(chr, range(128)))
    long = "यह दावा झूठा है। ૧ ક્યાં" * 30
    texts = [None, "", "-", "d", "दावा", "दावा झूठा\nहै, Modi 12", "દાવો ખોટો છે", long, long + every, "દાવો " * 90 + every, every, "தமிழ் அறிவு", "😀 न", "".join(map(chr, range(0x900, 0xB00)))]
    raw = [None if t is None else t.encode() for t in texts] + ["दावा".encode() * 9 + b"\xe0\xa4 A", b"\xff\xe0"]
    rows = spark.createDataFrame([(bytearray(b) if b is not None else None,) for b in raw], "b binary").select(F.col("b").cast("string").alias("t"))
    packed = rows.select("t", pack("t").alias("p"))
    back = packed.select(F.col("t").cast("binary").alias("t"), unpack("p").cast("binary").alias("u"), F.octet_length("p").alias("size")).collect()
    assert [r["u"] for r in back] == [r["t"] for r in back] and [None if r["t"] is None else bytes(r["t"]) for r in back] == raw
    assert all(r["size"] < len(r["t"]) / 2 for r in back if r["t"] in ("दावा".encode(), "દાવો ખોટો છે".encode()))


def test_texts_are_packed_and_not_spread_before_they_are_dealt(spark, path):
    """Grams and keyword scores deal the texts out themselves, one byte a letter; no shuffle takes them before."""
    for df in (queries_text.QUERIES["ngram_counts"][0](spark, path), queries_text.phrase_scores(spark, path)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" not in plan
        lines = plan.splitlines()
        dealt = [k for k, line in enumerate(lines) if "shufflepartitionidpassthrough" in line or "hashpartitioning(lang" in line and "batch" in line]
        assert dealt and all("IsDevanagari" in lines[k + 1] for k in dealt)


def test_phrase_lists_count_stopwords_once(spark, path, monkeypatch):
    calls, real = [], queries_text.stopwords
    for module in (queries_text, queries_storage):
        monkeypatch.setattr(module, "stopwords", lambda s, d: calls.append(1) or real(s, d))
    queries_storage.phrase_files(spark, path)
    assert len(calls) == 1

"""Collocations against SQL on given tables and brute force on small ones."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from claimloom.llm import collocations as mined
from claimloom.llm.queries import QUERIES
from oracle import compare, duck, sf_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, inside=100):
    """The result from (lang, text) rows by counting every phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f[lang].update(tuple(words[s:s + size]) for s in range(len(words) - size + 1))
    out = set()
    for lang, counts in f.items():
        kept, long = [], {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in long.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            holds = lambda q: any(q[s:s + len(p)] == p for s in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if not any(len(q) > len(p) and holds(q) and 100 * b >= inside * a for q, b in long.items()):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def got(spark, rows, **params):
    df = spark.createDataFrame(rows, "lang string, text string")
    return {tuple(r) for r in mined.collocations(df, **params).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def random_rows(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "x1", "lo ng", "c-d", "\x00"]
    fixed = ["the quick brown fox jumps over", "a b a b a b a", "x1 x1 x1 x1 x1 x1"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(8)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randrange(1, 9))))
            parts.append(rng.choice([" ", ", ", ".\n", "\t", "  ", ":", "\r\n", "!"]))
        rows.append((rng.choice(["en", None, "und", "fr"]), "".join(parts)))
    return [*rows, ("en", None), ("de", ""), (None, " , . ")]


@pytest.mark.parametrize("share", [1, 4, 1000])
@pytest.mark.parametrize("inside", [100, 60])
def test_brute_force(spark, share, inside):
    """Whatever the sample proposes - all, some or nothing - the result is the same."""
    rows = random_rows(share + inside)
    assert got(spark, rows, least=6, top=25, inside=inside, share=share) == brute(rows, 6, 25, inside)


def test_failures_of_the_border_are_expanded(spark, monkeypatch):
    """Nothing is proposed, so every frequent phrase is found by the border and its expansion."""
    real, passes = mined.counted, []

    def counted(docs, least, **params):
        passes.append("expansion" if params.get("failed") else "sample" if params.get("share") else "full")
        return real(docs, 10 ** 9 if params.get("share") else least, **params)

    monkeypatch.setattr(mined, "counted", counted)
    rows = random_rows(3)
    assert got(spark, rows, least=5, top=40) == brute(rows, 5, 40)
    assert passes == ["sample", "sample", "full", "expansion"]


def test_bitmaps_that_always_say_yes(spark, monkeypatch):
    monkeypatch.setattr(mined, "bitmap", lambda found, bits: b"\xff" * (1 << bits - 3))
    rows = random_rows(4)
    assert got(spark, rows, least=6, top=25) == brute(rows, 6, 25)


def test_bitmaps_hold_what_they_are_made_of(spark):
    rng = np.random.default_rng(1)
    some = rng.integers(0, 1 << 64, 30_000, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in some.view(np.int64)], "digest long")
    for bits in (16, 20):
        made = mined.Bitmap(mined.bitmap(df, bits))
        assert made.has(some).all()
    assert made.has(rng.integers(0, 1 << 64, 30_000, np.uint64)).mean() < 0.01


def test_sums_are_handed_on(monkeypatch):
    monkeypatch.setattr(mined, "HELD", 50)
    rng, sums, want, out, most = np.random.default_rng(2), mined.Sums(), Counter(), [], 0
    for _ in range(60):
        part = rng.integers(0, 90, 30).astype(np.uint64)
        want.update(part.tolist())
        sums.add(part, 3, np.uint64(_ + 7))
        out += [r for b in sums.rows() for r in b.to_pylist()]
        most = max(most, sums.size)
    out += [r for b in sums.rows(last=True) for r in b.to_pylist()]
    found = Counter()
    for r in out:
        found[r["digest"]] += r["count"]
    assert found == want and most <= 50 and {r["length"] for r in out} == {3}
    assert min(r["portion"] for r in out) == 7


def test_portions_by_language(monkeypatch):
    monkeypatch.setattr(mined, "TEXTS", 40)
    texts = [f"text number {k}" * (k % 4) for k in range(50)]
    langs = [("en", None, "fr")[k % 3] for k in range(50)]
    batch = pa.RecordBatch.from_pydict({"lang": langs, "text": texts})
    out = defaultdict(list)
    for lang, part, _ in mined.by_language([batch]):
        out[lang] += part
    assert {k: sorted(v) for k, v in out.items()} == {
        k.encode(): sorted(t.encode() for t, x in zip(texts, langs) if (x or "und") == k) for k in ("en", "fr", "und")}


def test_shared_digests_are_noticed(spark, monkeypatch):
    """Counts of digests that are wrong in the result lead to counts of the phrases themselves."""
    real, rows = mined.named_counts, random_rows(6)
    wrong = mined.F.when(mined.F.col("phrase") == "a b", mined.F.col("count") + 1).otherwise(mined.F.col("count"))
    monkeypatch.setattr(mined, "named_counts", lambda docs, found: real(docs, found).withColumn("count", wrong))
    assert got(spark, rows, least=6, top=25) == brute(rows, 6, 25)


def test_long_text_ties_and_repeated_rows(spark):
    rows = [("en", "p q r s t u v " * 20_000), ("fr", "b a, a b, " * 5), ("fr", "b a, a b, " * 5)]
    assert got(spark, rows, least=5, top=3) == brute(rows, 5, 3)


def test_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("x", None, 0, 9_000_000_000_000), ("x", "a b", 2, 7_000_000_000_001), ("x", "a", 1, 7_000_000_000_003), ("x", "b", 1, 8_000_000_000_007)],
        "lang string, phrase string, length int, count long")
    assert [r["score"] for r in mined.scored(counts).collect()] == [
        1000 * 7_000_000_000_001 * 9_000_000_000_000 // (7_000_000_000_003 * 8_000_000_000_007)]


def test_empty_and_other_columns(spark):
    assert got(spark, []) == set()
    df = spark.createDataFrame([(1, "en", "m n. " * 120, 5, "z")], "doc_id int, lang string, text string, count int, phrase string")
    assert [tuple(r) for r in mined.collocations(df).collect()] == [("en", 1, "m n", 120, 120, 120, 240, 2000)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_tables_equal_sql(spark, sf):
    run, sql = QUERIES["op12_collocations"]
    diff, rows = compare(spark, duck(sf_dir(sf)), "op12", run, sql, sf_dir(sf))
    assert not diff and rows > 30

"""SimHash groups against all pairs, and components against a plain union-find."""

import random
import re

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from claimloom.llm import simhash, spans
from claimloom.llm.components import components
from claimloom.llm.queries import QUERIES, read


def plain(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def grouped(rows):
    """(doc_id, fingerprint, component) by comparing all pairs of distinct fingerprints."""
    fps = [plain(r["text"]) for r in rows]
    least = {}
    for r, fp in zip(rows, fps):
        least[fp] = min(least.get(fp, r["doc_id"]), r["doc_id"])
    seen = sorted(least)
    root = union_find([(a, b) for i, a in enumerate(seen) for b in seen[i:] if bin(a ^ b).count("1") <= 2])
    smallest = {}
    for fp in seen:
        smallest[root[fp]] = min(smallest.get(root[fp], least[fp]), least[fp])
    return sorted((r["doc_id"], f"{fp:016x}", smallest[root[fp]]) for r, fp in zip(rows, fps))


def test_query(spark, path):
    got = sorted(map(tuple, QUERIES["op3_simhash"][0](spark, path).collect()))
    assert got == grouped(read(spark, path, "documents").collect())


def test_all_links_within_two_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, 2**64 - 1, 1, 3, 7, 1 << 63, *base}
    for x in base:
        for _ in range(20):
            y = x
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << bit
            fps.add(y)
    signed = sorted(x - (x >> 63 << 64) for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for distance in (0, 1, 2, 3):
        want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bin((a ^ b) & (2**64 - 1)).count("1") <= distance}
        assert {tuple(r) for r in simhash.links(df, distance).collect()} == want


def test_links_broadcast_nothing(spark, tmp_path):
    spark.range(20_000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    plans = [found._jdf.queryExecution().executedPlan().toString()]
    found.collect()
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert all("Broadcast" not in plan and "SortMergeJoin" in plan for plan in plans)


def test_anchors_are_code_words_within_two_bits(spark):
    low = [0, 1, 5, 2**31 - 1, 123456789]
    rows = spark.createDataFrame([(x,) for x in low], "low long").select("low", simhash.anchors(F.col("low")).alias("all")).collect()
    for r in rows:
        assert len(set(r["all"])) == len(r["all"]) in (1, 16)
        for a in r["all"]:
            parity = 0
            for place in range(1, 32):
                parity ^= place * (a >> (place - 1) & 1)
            assert parity == 0 and bin(a ^ r["low"]).count("1") <= 2


CASES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "a b c d e f g h"), (8, "A B C D E F G H"),
    (9, "a b c d"), (10, "É x y z"), (11, "é x y z"), (12, "w " * 30000), (None, "a b c d e f g h"), (None, "alone in the world"),
    (7, "a b c d e f g h"), (7, "another text with the same id"), (13, "x\x1cy \x85 z"),
]


@pytest.mark.parametrize("most", [0, 500_000])
def test_edge_rows_and_clashing_columns(spark, monkeypatch, most):
    monkeypatch.setattr(spans, "BROADCAST_DOCS", most)
    rows = [Row(doc_id=i, text=t, fp="x", version=1, root=2, first=3) for i, t in CASES]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, version int, root int, first int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(CASES)
    ids = {(r["doc_id"], r["component_id"]) for r in got}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (8, 7), (None, 7), (None, None)} <= ids
    prints = sorted(f"{r['fp'] & (2**64 - 1):016x}" for r in got)
    assert prints == sorted(f"{plain(t):016x}" for _, t in CASES)
    kept = simhash.first_of_groups(df)
    assert kept.columns == df.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) and (1, None) in texts and (2, "") not in texts
    assert texts.count((7, "a b c d e f g h")) == 1 and (None, "alone in the world") in texts and (None, "a b c d e f g h") not in texts


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == [] and simhash.first_of_groups(df).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    names = list(range(300))
    rng.shuffle(names)
    pairs = {
        "chain": list(zip(names, names[1:])), "star": [(names[0], x) for x in names[1:]],
        "random": [(rng.choice(names), rng.choice(names)) for _ in range(200)], "none": [],
    }[shape]
    df = spark.createDataFrame(pairs + [(None, 5), (7, None)], "a long, b long")
    want = {x: r for x, r in union_find(pairs).items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert {r["node"]: r["root"] for r in components(df).collect()} == want

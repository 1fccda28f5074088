"""Toxicity by held-out accuracy, and the kernel against its definition."""

from itertools import combinations

import numpy as np
from pyspark.sql import Row

from claimloom.llm import toxicity
from claimloom.llm.codes import chunks
from claimloom.llm.queries import QUERIES, read


def string(text):
    return bytes(ord(c) - 96 for c in text)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in read(spark, path, "labels").collect()}
    rows = QUERIES["op6_toxicity"][0](spark, path).collect()
    assert len(rows) == read(spark, path, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) / len(held) >= 0.93


def test_kernel_is_its_definition():
    def features(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            if k - i <= 4:
                u = word[i], word[j], word[k]
                out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    def norm(n):
        return np.sqrt(max(sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, j, k in combinations(range(n), 3) if k - i <= 4), 1))

    words = ["idiot", "idxiot", "banana", "abc", "ab", "aaaaaa", "clownish"]
    got = toxicity.kernel([string(w) for w in words], [string(w) for w in words])
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            f, g = features(x), features(y)
            want = sum(v * g.get(u, 0) for u, v in f.items()) / norm(len(x)) / norm(len(y))
            assert abs(got[a, b] - want) < 1e-5


def found(text):
    out = []
    for _, ends, codes in chunks([text]):
        sign, start, length, part = toxicity.strings(codes, ends)
        out += ["".join(chr(96 + x) if x < 27 else "?" for x in sign[s:s + n]) for s, n in zip(start, length)]
    return out


def test_strings():
    assert found("You  I.D.I.O.T, s t u p i d ones; id1ot a-b") == ["you", "idiot", "stupid", "ones", "idiot", "ab"]
    assert found("") == [] and found("... !!") == [] and found("a") == ["a"] and found("é x") == ["?x"]
    assert found("a b") == ["ab"] and found("ab c d ef") == ["ab", "cd", "ef"]
    long = found("abcdefghijklmnopqrstuvwxyz" * 3)
    assert all(len(x) <= toxicity.LONGEST for x in long) and long[0][12:] == long[1][:12] and long[-1].endswith("z")


def frame(spark, rows):
    return spark.createDataFrame([Row(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, toxic string, best int")


def test_small_tables_and_edges(spark):
    clean = [(i, f"a plain sentence number {i} about rivers and hills.\nThe weather was fine.", "en") for i in range(200)]
    bad = [(1000 + i, f"a plain sentence number {i} about rivers, you blockhead.\nThe weather was fine.", "en") for i in range(200)]
    labels = spark.createDataFrame([(r[0], int(r[0] >= 1000), 0) for r in clean + bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(frame(spark, clean + bad + [(None, "x", "en"), (7777, None, "en")]), labels)
    tests = [(1, "you b.l.o.c.k.h.e.a.d", None), (2, "rivers and hills", None), (3, None, None), (4, "", None), (5, "block  head block", None),
             (6, "blockxhead", None), (7, "fine " * 200000 + "blockhead", None), (None, "b l o c k h e a d", None), (1, "you b.l.o.c.k.h.e.a.d", None)]
    got = toxicity.score(frame(spark, tests), model).collect()
    assert len(got) == len(tests)
    toxic = {r["doc_id"]: r["score"] >= 0.3 for r in got}
    assert (toxic[1], toxic[2], toxic[3], toxic[4], toxic[6], toxic[7], toxic[None]) == (True, False, False, False, True, True, True)
    assert toxicity.score(frame(spark, []), model).collect() == []
    none = toxicity.train(frame(spark, []), labels.filter("false"))
    assert [r["score"] < 0.3 for r in toxicity.score(frame(spark, tests[:2]), none).collect()] == [True, True]


def test_scores_do_not_depend_on_the_size_of_the_sample(spark):
    """Half of the texts with the word are toxic, of whichever number of clean ones the sample holds."""
    docs = [(i, f"you blockhead number {'abc'[i % 3]}" if i < 160 else "a plain text about garden and river") for i in range(1600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i, _ in docs], "doc_id long, toxic int")
    for per_label in (60, 3000):
        score = toxicity.train(frame, labels, per_label=per_label).score(["you blockhead"])[0]
        assert 0.35 < score < 0.65

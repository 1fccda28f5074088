"""Decontamination against plain Python, and its SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import Row

from claimloom.llm import decontaminate as de
from claimloom.llm import spans
from claimloom.llm.queries import QUERIES
from oracle import compare


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, window=10):
    """(doc_id, n_words, n_hit, items) by looking for every window at every place."""
    out = []
    for doc_id, text in docs:
        have, hit, found = words(text), set(), set()
        for item_id, item in items:
            want = words(item)
            size = min(window, len(want))
            for s in range(len(want) - size + 1) if want else ():
                for p in range(len(have) - size + 1):
                    if have[p:p + size] == want[s:s + size]:
                        hit |= set(range(p, p + size))
                        found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(have), len(hit), sorted(found)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    extra = dict(pos=1, term="t", version="v", item=2, diagonal=3, n=4)
    return (
        spark.createDataFrame([Row(doc_id=i, text=t, **extra) for i, t in docs], "doc_id long, text string, pos int, term string, version string, item int, diagonal int, n int"),
        spark.createDataFrame([Row(item_id=i, text=t, **extra) for i, t in items], "item_id long, text string, pos int, term string, version string, item int, diagonal int, n int"),
    )


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (1, "short one"), (2, ""), (3, None), (4, "the the the the the the the the the the the the"), (None, "null item words"),
         (5, "Éa éa " + " ".join(f"x{i}" for i in range(9))), (10, "Short, ONE!"), (11, "absent words only here")]
DOCS = [
    (1, LONG), (2, f"Before {LONG.upper()}, after"), (3, " ".join(f"w{i}" for i in range(9))), (4, " ".join(f"w{i}" for i in range(5, 15))),
    (5, None), (6, ""), (7, "... !!"), (8, "a short one, a Short-One and short two"), (9, "the " * 30), (10, "the " * 9), (11, "null item words"),
    (12, "Éa éa " + " ".join(f"X{i}" for i in range(9))), (13, "éa éa " + " ".join(f"x{i}" for i in range(9))),
    (14, " ".join(f"w{i}" for i in range(8)) + " odd " + " ".join(f"w{i}" for i in range(8, 16))), (None, "short one"), (1, LONG), (1, "other text, same id"),
    (15, ("filler words here " * 4000) + LONG + (" more filler" * 4000)),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_cases(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(spans, "BROADCAST_DOCS", 0)
        monkeypatch.setattr(de, "broadcast_if_small", lambda df, **_: df)
    docs, items = frames(spark, DOCS, ITEMS)
    rows = de.decontaminate(docs, items).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=repr) == plain(DOCS, ITEMS)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in rows)
    near = {r["doc_id"]: r["n_near"] for r in rows}
    assert near[14] == 1 and near[3] == 1 and near[5] == 0  # a word put in; nine of ten words


def test_random_texts(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "of", "the", "É", "é", "Zz", "9"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "- "]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 25))) for i in range(12)]
    docs = [(i, text(rng.randrange(0, 60)) + rng.choice(items)[1] + text(5)) for i in range(60)]
    rows = de.decontaminate(*frames(spark, docs, items)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=repr) == plain(docs, items)


def leaks(text, items):
    """Whether a text holds an exact match, or a proximity match of an item of a whole window or more."""
    return plain([(0, text)], items)[0][2] > 0 or plain_near([(0, text)], [(i, t) for i, t in items if len(words(t)) >= 10])[0][1] > 0


def test_clean_documents(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    kept = de.clean_documents(docs, items)
    assert kept.columns == docs.columns
    bad = {(i, t) for (i, t) in DOCS if leaks(t, ITEMS)}
    assert (14, DOCS[13][1]) in bad and (3, DOCS[2][1]) in bad and (10, "the " * 9) in bad
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted((d for d in DOCS if d not in bad), key=repr)


@pytest.mark.parametrize("docs, items", [([], ITEMS[:1]), (DOCS[:2], []), ([], [])])
def test_empty_tables(spark, docs, items):
    rows = de.decontaminate(*frames(spark, docs, items)).collect()
    assert [(r["doc_id"], r["n_hit"], r["n_near"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(i, 0, 0) for i, _ in docs]


def test_query_equals_sql(spark, con, path):
    run, sql = QUERIES["op4_decontamination"]
    diff, rows = compare(spark, con, "op4", run, sql, path)
    assert not diff and rows == 200


def test_digest_of_items(spark, path):
    rows = QUERIES["op4_decontamination"][0](spark, path).collect()
    assert {r["items_sha256"] for r in rows if not r["n_items"]} == {hashlib.sha256(b"").hexdigest()}


def plain_near(docs, items, window=10, near=8, slop=2):
    """(doc_id, n_near) by counting, for every item, window and group of diagonals, the places that match."""
    out = []
    for doc_id, text in docs:
        have, found = words(text), 0
        for want in map(words, {t for _, t in items}):
            places = {}
            for p, a in enumerate(want):
                for q, b in enumerate(have):
                    if a == b:
                        for group in range(q - p, q - p + slop + 1):
                            places.setdefault(group, set()).add(p)
            most = max((len(x & set(range(s, s + window))) for x in places.values() for s in range(len(want))), default=0)
            found += bool(want) and most >= min(len(want), near)
        out.append((doc_id, found))
    return sorted(out)


def test_near_against_brute_force(spark):
    """The rarest words replaced, unseen in the corpus, or parted by a word put in."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    items, docs = [], []
    for i in range(14):
        item = [rng.choice(common) for _ in range(rng.choice([3, 7, 8, 9, 10, 10, 14, 25]))]
        for at in rng.sample(range(len(item)), min(2, len(item))):
            item[at] = f"rare{i}n{at}"
        items.append((i, " ".join(item)))
        for k in range(8):
            copy = list(item)
            for at in rng.sample(range(len(copy)), min(k % 4, len(copy))):
                copy[at] = rng.choice(common)
            if k % 2:
                copy.insert(rng.randrange(len(copy)), "between")
            if k == 5:
                copy = [w for w in copy if not w.startswith("rare")]
            docs.append((100 * i + k, " ".join([*rng.choices(common, k=5), *copy, *rng.choices(common, k=5)])))
    item = "r1 r2 a b c d e f g h"
    items.append((90, item))
    items.append((91, "u1 a2 b2 c2 d2 e2 f2 g2 h2 i2"))
    docs += [(9000, item.replace("r1", "x")), (9001, item.replace("r2", "x")), (9002, item.replace("r1 r2", "r1 x r2")),
             (9003, "u a2 b2 c2 d2 e2 f2 g2 h2 i2"), (9004, "a b c d e f g h"), (9005, "a b c d e f g")]
    want = plain_near(docs, items)
    assert dict(want)[9000] == dict(want)[9002] == dict(want)[9003] == 1
    rows = de.decontaminate(*frames(spark, docs, items)).collect()
    assert sorted((r["doc_id"], r["n_near"]) for r in rows) == want
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows), key=repr) == plain(docs, items)

"""Embedding groups against all pairs in double precision."""

import numpy as np
import pytest
from pyspark.sql import Row

from claimloom.llm import embeddings
from claimloom.llm.queries import QUERIES, read
from oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, h1 int, copies int, cell int"


def brute(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) by position of the row."""
    good = []
    for i, (_, v, label) in enumerate(rows):
        if label is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.append((i, label, np.float32(v).astype(np.float64)))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a, x) in enumerate(good):
        for j, b, y in good[k + 1:]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([Row(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def test_query(spark, path):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in read(spark, path, "embeddings").collect()]
    got = sorted((tuple(r) for r in QUERIES["op9_embedding_dedup"][0](spark, path).collect()), key=repr)
    assert got == brute(rows)


def test_query_equals_sql(spark, con, path):
    diff, rows = compare(spark, con, "op9", *QUERIES["op9_embedding_dedup"], path)
    assert not diff and rows == 500


def clusters(seed, n=400, d=24):
    """Vectors around a few centres, most pairs near the threshold, some of them copies and negatives."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=d) * rng.choice([0.0, 0.08, 0.12, 0.3])
        out.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3, -1])], int(rng.integers(2))))
    return out


EDGE = [
    (900, None, 0), (901, [], 0), (902, [0.0] * 24, 0), (903, [float("nan")] + [1.0] * 23, 0), (904, [float("inf")] + [1.0] * 23, 0),
    (905, [None] + [1.0] * 23, 0), (906, [1.0] * 24, None), (907, [1.0] * 24, 5), (908, [2.0] * 24, 5), (908, [2.0] * 24, 5), (None, [3.0] * 24, 5),
    (909, [1.0], 5), (910, [7.0], 5), (911, [-7.0], 5), (912, [1.0, 1.0], 5), (913, [1e30] * 24, 5), (914, [1e-30] * 24, 5), (None, None, None), (None, [1.0, -1.0], 6),
]


@pytest.mark.parametrize("tile", [1024, 40])
def test_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = clusters(4) + EDGE
    got = sorted((tuple(r) for r in embeddings.near_duplicates(frame(spark, rows)).collect()), key=repr)
    want = brute(rows)
    unlinked = [r[0] for r in rows if r[0] is not None and (r[1] is None or r[2] is None)]
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]
    assert all((i, 0, i, True) in got for i in unlinked)
    assert len(got) == len(rows)


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(60, 32)) + 3 * c for c in rng.normal(size=(4, 32))])
    q = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    u = embeddings.unit(x)
    for threshold in (0.5, 0.9, 0.95, 0.99):
        for basis in ({}, {32: q}):
            i, j = embeddings.linked(x, x, threshold, basis)
            assert set(zip(i.tolist(), j.tolist())) == {tuple(p) for p in np.argwhere(u @ u.T >= threshold).tolist()}


def test_empty_table(spark):
    assert embeddings.near_duplicates(frame(spark, [])).collect() == []

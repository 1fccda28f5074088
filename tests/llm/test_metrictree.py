"""Vector codes against plain rounds on all vectors, and the trees against their definition."""

import hashlib

import numpy as np
import pytest

from claimloom.llm import metrictree
from claimloom.llm.queries import QUERIES, op13_vector_codes, read
from oracle import compare, duck, sf_dir


def plain(rows, entries=256, rounds=4, parts=4):
    """vec_id → (code, error, label_error, digest) of (vec_id, vector, label) rows, all vectors of one length."""
    rows = sorted(rows, key=lambda r: (r[0], list(r[1])))
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    x = x.reshape(len(rows), parts, -1)
    books, codes, error = [], [""] * len(rows), np.zeros(len(rows), np.int64)
    for part in range(parts):
        book, points = x[:entries, part].copy(), x[:, part]
        for _ in range(rounds):
            owner = np.argmin(((points[:, None] - book) ** 2).sum(2), axis=1)
            for k in np.unique(owner):
                mine = points[owner == k]
                book[k] = [int(s) // len(mine) for s in mine.sum(0)]
        far = ((points[:, None] - book) ** 2).sum(2)
        owner = np.argmin(far, axis=1)
        error += far[np.arange(len(rows)), owner]
        codes = [c + f"{k:02x}" for c, k in zip(codes, owner)]
        books.append(book)
    digest = hashlib.sha256(",".join(str(int(v)) for v in np.array(books).reshape(-1)).encode()).hexdigest()
    by_label = {}
    for r, e in zip(rows, error.tolist()):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted((r[0], c, e, by_label[r[2]], digest) for r, c, e in zip(rows, codes, error.tolist()))


def got(spark, rows, schema="vec_id long, embedding array<float>, label int", **params):
    out, _ = metrictree.compress(spark.createDataFrame(rows, schema), **params)
    return sorted(tuple(r) for r in out.drop("label").collect())


def vectors(seed, n, d, kind):
    rng = np.random.default_rng(seed)
    if kind == "even":
        x = rng.normal(size=(n, d)) / 8
    elif kind == "clustered":
        x = rng.normal(size=(12, d))[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) / 100
    elif kind == "copies":
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n) ** 2 // 40]
    else:  # ties: few different numbers
        x = rng.integers(-2, 3, (n, d)) / 1024
    ids = rng.permutation(n) * 3 - n
    return [(int(i), [float(v) for v in np.float32(row)], None if i % 5 == 0 else int(i % 3)) for i, row in zip(ids, x)]


@pytest.mark.parametrize("kind", ["even", "clustered", "copies", "ties"])
def test_plain_rounds(spark, kind):
    rows = vectors(7, 900, 8, kind)
    assert got(spark, rows) == plain(rows)


def test_few_vectors_and_entries(spark):
    rows = vectors(3, 5, 4, "even")
    assert got(spark, rows) == plain(rows)
    rows = vectors(4, 300, 12, "clustered")
    assert got(spark, rows, entries=7, rounds=9) == plain(rows, 7, 9)


@pytest.mark.parametrize("kind", ["even", "clustered", "copies", "ties"])
@pytest.mark.parametrize("size", [1, 3, 1 << 12, 1 << 23])
def test_owners_equal_all_distances(kind, size):
    rng = np.random.default_rng(5)
    points = np.floor(np.array([r[1] for r in vectors(11, 2000, 5, kind)]) * size * 8).astype(np.int64)
    entries = np.concatenate([points[rng.integers(0, len(points), 60)], rng.integers(-size, size + 1, (20, 5))])
    tree = metrictree.Tree(points)
    sums, counts, owner, far = tree.owners(entries, metrictree.spans(entries), each=True)
    every = ((points[:, None].astype(object) - entries) ** 2).sum(2)
    want = np.argmin(every.astype(np.int64), axis=1)
    assert np.array_equal(owner, want) and np.array_equal(far, every[np.arange(len(points)), want].astype(np.int64))
    for k in range(len(entries)):
        assert counts[k] == (want == k).sum() and np.array_equal(sums[k], points[want == k].sum(0))


def test_balls():
    points = np.floor(np.array([r[1] for r in vectors(2, 3000, 6, "clustered")]) * 1024).astype(np.int64)
    tree = metrictree.Tree(points)
    assert np.array_equal(tree.rows[tree.row], points)
    for k in range(len(tree.lo)):
        mine, times = tree.rows[tree.lo[k]:tree.hi[k]], tree.times[tree.lo[k]:tree.hi[k]]
        assert (metrictree.lengths(mine.astype(float), tree.center[k]) <= tree.radius[k] + 1e-9).all()
        assert np.array_equal(tree.sum[k], (mine * times[:, None]).sum(0)) and tree.count[k] == times.sum()
        spans = sorted((tree.lo[c], tree.hi[c]) for c in tree.children[k])
        if spans:
            assert spans[0][0] == tree.lo[k] and spans[-1][1] == tree.hi[k] and spans[0][1] == spans[1][0]
        else:
            assert tree.hi[k] - tree.lo[k] <= metrictree.LEAF
    assert tree.hi[-1] - tree.lo[-1] == len(tree.rows)


def test_balls_are_owned_whole(monkeypatch):
    """In clusters with an entry each, cached sums do nearly all the work."""
    rows = vectors(2, 3000, 6, "clustered")
    points = np.floor(np.array([r[1] for r in rows]) * 1024).astype(np.int64)
    tree, seen, real = metrictree.Tree(points), [], metrictree.distances
    centers = np.unique(points // 512, axis=0, return_index=True)[1]
    entries = points[centers]
    between = metrictree.spans(entries)
    monkeypatch.setattr(metrictree, "distances", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    tree.owners(entries, between)
    assert sum(seen) < len(tree.rows) * len(entries) / 4


def test_unfit_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [0.5, -0.25, 0.1, 2.0], 1), (1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (4, [nan, 0.0, 0.0, 0.0], 1), (5, [0.0, inf, 0.0, 0.0], None),
        (6, [0.0, 0.0, 0.0, 0.0], None), (6, [0.0, 0.0, 0.0, 0.0], None), (0, [1.0, 1.0, 1.0], 1), (8, [], 2), (9, [3e38, 0.0, 0.0, 0.0], 1), (None, [0.0, 0.0, 0.0, 0.5], 1),
    ]
    fit = plain([(6, [0.0] * 4, None), (6, [0.0] * 4, None), (3, rows[0][1], 1), (7, [0.0, 0.0, 0.0, 0.5], 1)])
    digest, label = fit[0][4], next(r[3] for r in fit if r[0] == 3)
    want = {(None if r[0] == 7 else r[0], *r[1:]) for r in fit} | {(0, None, None, label, digest), (8, None, None, 0, digest), (9, None, None, label, digest)}
    found = metrictree.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))[0].drop("label").collect()
    assert {tuple(r) for r in found} == want and len(found) == 7


def test_other_types_and_columns(spark):
    rows = [(f"v{i}", r[1], f"l{r[2]}", i, "x") for i, r in enumerate(vectors(9, 40, 4, "even"))]
    out, books = metrictree.compress(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string, error int, code string"))
    assert sorted(tuple(r) for r in out.drop("label").collect()) == plain([r[:3] for r in rows]) and books.shape == (4, 40, 1)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 2)]) == []


def test_blocks_of_several_batches(spark, monkeypatch):
    rows = vectors(13, 700, 8, "even")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_given_table(spark, path):
    rows = [tuple(r) for r in read(spark, path, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in op13_vector_codes(spark, path).collect()) == plain(rows)


def test_given_table_equals_sql(spark):
    run, sql = QUERIES["op13_vector_codes"]
    diff, rows = compare(spark, duck(sf_dir("0.01")), "op13", run, sql, sf_dir("0.01"))
    assert not diff and rows == 500

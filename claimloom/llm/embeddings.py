"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label are cut into tiles, and each pair of tiles that may hold a link is
one task of bounded size. There the vectors are turned onto principal axes, so the
leading dimensions hold most of the length. Products are summed block by block of
dimensions; what the rest can still add is bounded by the product of the suffix norms,
and a pair whose bound is below the threshold is dropped. Pairs that are left get their
exact cosine. A task returns link counts and a spanning forest, never pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm.components import components
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small, spread

#: Vectors of a tile.
TILE = 1024
#: Numbers in the sample that the axes are fitted on, and its vectors. The axes set the order of work, not the result.
SAMPLE_NUMBERS, SAMPLE_VECTORS = 2_000_000, 5_000
#: Leading axes that part the vectors into cells.
CELL_AXES = 2
#: Dimensions that are summed before the first bound; each next block has twice as many.
FIRST_BLOCK = 8
#: What rounding may take from a bound.
SLACK = 1e-7


def sound(vector):
    """Whether a vector has a direction: not null, no null or non-finite component, not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good) & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(vectors):
    """(cls, label, vector, copies): different vectors of a label, numbered; keyed by two digests."""
    return vectors.groupBy("label", "h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"))


def axes(distinct):
    """{dimensions: orthogonal matrix}, its columns by falling variance, of a bounded sample."""
    sizes = distinct.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count")).limit(16).collect()
    out = {}
    for d, _ in sizes:
        n = max(1, min(SAMPLE_VECTORS, SAMPLE_NUMBERS // d))
        rows = distinct.filter(F.size("vector") == d).orderBy("h1", "h2").limit(n).select("vector").collect()
        x = unit(np.array([r["vector"] for r in rows], np.float64))
        out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def unit(x):
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cells(distinct, basis, reach):
    """`distinct` with `cell`, the square of side `reach` on the leading axes that a vector lies in.

    Two vectors at most `reach` apart lie in one cell or in neighbouring ones.
    """
    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            sizes, out = lists.value_lengths().to_numpy(zero_copy_only=False), np.zeros((len(lists), CELL_AXES), np.int32)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = unit(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d))
                lead = (x @ basis[d][:, :CELL_AXES]) if d in basis else x[:, :CELL_AXES]
                out[at, :lead.shape[1]] = np.floor(lead / reach)
            cell = pa.array(list(out), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], [*batch.schema.names, "cell"])

    schema = distinct.withColumn("cell", F.array().cast("array<int>")).schema
    return distinct.mapInArrow(run, schema)


def tile_pairs(placed):
    """(pair, side, cls, copies, vector): each vector for every pair of tiles that its tile is in.

    A cell of a label has as many tiles as its size asks for, by a digest of the vector.
    A cell is paired with itself and with those neighbours that sort after it.
    """
    here = ["label", F.size("vector").alias("d"), "cell"]
    count = placed.groupBy(*here).count()
    sized = stored(count.select("label", "d", "cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "cells")
    steps = F.transform(F.sequence(F.lit(0), F.lit(3 ** CELL_AXES - 1)), lambda i: F.array(*(
        ((i / F.lit(3 ** k)).cast("int") % 3 - 1).cast("int") for k in range(CELL_AXES))))
    moved = sized.select("label", "d", "cell", "tiles", F.explode(steps).alias("step")).select(
        "label", "d", "cell", "tiles", F.zip_with("cell", "step", lambda a, b: (a + b).cast("int")).alias("other"))
    mine, its = moved.alias("a"), sized.alias("b")
    near = mine.join(its, (F.col("a.label") == F.col("b.label")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.other") == F.col("b.cell")))
    near = near.groupBy("a.label", "a.d", "a.cell").agg(
        F.first("a.tiles").alias("tiles"), F.collect_list(F.struct(F.col("b.cell").alias("cell"), F.col("b.tiles").alias("tiles"))).alias("near"))
    near = broadcast_if_small(stored(near, "near-cells"))
    rows = placed.alias("v").join(near.alias("n"), (F.col("v.label") == F.col("n.label")) & (F.size("v.vector") == F.col("n.d")) & (F.col("v.cell") == F.col("n.cell")))
    tile = F.pmod(F.xxhash64("v.h2", "v.h1"), F.col("tiles")).cast("int")
    rows = rows.select("v.label", "n.d", "v.cell", tile.alias("tile"), "cls", "copies", "vector", F.explode("near").alias("it"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("it.tiles") - 1)).alias("its_tile"))
    mine, its = F.struct("cell", "tile"), F.struct(F.col("it.cell").alias("cell"), F.col("its_tile").alias("tile"))
    return rows.select(
        F.struct("label", "d", F.least(mine, its).alias("first"), F.greatest(mine, its).alias("second")).alias("pair"),
        (mine > its).alias("second"), "cls", "copies", "vector",
    )


def linked(a, b, threshold, basis):
    """(i, j) of the rows of `a` and `b` whose cosine reaches the threshold."""
    x, y = unit(a), unit(b)
    d = x.shape[1]
    turned = basis.get(d)
    p, q = (x, y) if turned is None else (x @ turned, y @ turned)
    left = lambda z, k: np.sqrt(np.maximum(np.einsum("ij,ij->i", z[:, k:], z[:, k:]), 0))
    k = min(FIRST_BLOCK, d)
    dense = p[:, :k] @ q[:, :k].T
    i, j = np.nonzero(dense + np.outer(left(p, k), left(q, k)) >= threshold - SLACK)
    total = dense[i, j]
    while k < d and len(i):
        step = min(d, 2 * k)
        rest, its = left(p, step), left(q, step)
        keep_i, keep_j, keep = [], [], []
        for s in range(0, len(i), 1 << 16):
            u, v = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
            t = total[s:s + (1 << 16)] + np.einsum("ij,ij->i", p[u, k:step], q[v, k:step])
            alive = t + rest[u] * its[v] >= threshold - SLACK
            keep_i.append(u[alive])
            keep_j.append(v[alive])
            keep.append(t[alive])
        i, j, total, k = np.concatenate(keep_i), np.concatenate(keep_j), np.concatenate(keep), step
    exact = np.concatenate([np.empty(0), *(cosine(a[i[s:s + (1 << 16)]], b[j[s:s + (1 << 16)]]) for s in range(0, len(i), 1 << 16))])
    return i[exact >= threshold], j[exact >= threshold]


def cosine(a, b):
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def least_reachable(n, i, j):
    """For each of `n` nodes the least node that the links (i, j) reach."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def compare(table, threshold, basis):
    """Of one pair of tiles: (cls, links, root) of every class with a link in it."""
    second = table.column("second").to_numpy(zero_copy_only=False)
    ids = table.column("cls").to_numpy()
    copies = table.column("copies").to_numpy()
    flat = table.column("vector").combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    a, b = np.flatnonzero(~second), np.flatnonzero(second)
    if len(b):
        i, j = linked(x[a], x[b], threshold, basis)
        i, j = a[i], b[j]
    else:  # a tile with itself
        i, j = linked(x, x, threshold, basis)
        i, j = i[i < j], j[i < j]
    n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    order = np.argsort(ids, kind="stable")  # so that the least node is the least class
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = ids[order][least_reachable(len(ids), place[i], place[j])][place]
    some = np.flatnonzero(n)
    return pa.table({"cls": ids[some], "links": n[some].astype(np.int64), "root": root[some]})


def near_duplicates(vectors, threshold=0.98, vec_id="vec_id", vector="embedding", label="label"):
    """Links between vectors of one label with a cosine of at least `threshold`, one row per row.

    Columns: vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    reachable, itself included), kept (vec_id = component_id). Cosines are taken in double
    precision from the vectors themselves.

    A vector that is null, empty or zero or has a null or non-finite component links with
    nothing, nor do one with a null label and vectors of different length. Copies are one
    class, compared once; a repeated row counts as a vector of its own. A null vec_id keeps its row and is never the
    smallest; a group of such rows alone has a null component and is kept. Only the named
    columns are read. An empty table gives an empty result.
    """
    rows = spread(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")))
    rows = rows.withColumn("sound", F.col("label").isNotNull() & sound(F.col("vector")))
    rows = rows.select("*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector", F.size("vector")).alias("h2"))
    distinct = classes(rows.filter("sound")).withColumn("cls", F.monotonically_increasing_id())
    distinct = stored(distinct, "vector-classes")
    basis = axes(distinct)
    reach = float(np.sqrt(max(2 - 2 * threshold, 0)) + SLACK)
    shared = vectors.sparkSession.sparkContext.broadcast(basis)
    pairs = tile_pairs(stored(cells(distinct, basis, reach), "cells-of-vectors"))

    def run(table):
        return compare(table, threshold, shared.value)

    found = stored(
        pairs.groupBy("pair").applyInArrow(lambda table: run(table.drop_columns(["pair"])), "cls long, links long, root long"), "links"
    )
    roots = components(found.select("cls", "root"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    linked_classes = distinct.select("cls", "label", "h1", "h2", "copies").join(links, "cls", "left").join(
        roots, F.col("cls") == F.col("node"), "left").select(
        "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    named = broadcast_if_small(stored(linked_classes, "linked-classes"))
    alike = (F.col("a.label") == F.col("b.label")) & (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
    placed = stored(rows.drop("vector").alias("a").join(named.alias("b"), alike & F.col("a.sound"), "left").select("vec_id", "n_links", "root"), "placed")
    least = broadcast_if_small(stored(placed.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least")), "least"))
    out = placed.alias("a").join(least.alias("b"), F.col("a.root") == F.col("b.root"), "left")
    component = F.when(F.col("a.root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

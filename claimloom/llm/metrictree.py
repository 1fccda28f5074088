"""Vector codes by product quantization over metric trees of an anchors hierarchy.

Each part of the vectors has a codebook, fitted by rounds of assigning every part to its nearest
entry and moving the entries to the means. A task builds, once, a tree over each part of each block of its vectors, from
the middle out: some sqrt(n) anchors, each taking the points that are nearer to it than to the others',
are built below from their own points and joined above by the smallest balls. A ball caches the sum and number of its
points. In a round a ball inherits the entries that may own points of its parent and drops those that a nearer one beats
everywhere in it; when one is left, the ball is wholly owned and its cached sum counts for that entry.

All components are whole numbers. Bounds are taken in floating point with room for rounding, and what
they leave open is decided by exact distances, so every round is exact.
"""

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm.worker import kept
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small, spread

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Numbers of a block, and points of a ball that is not parted further.
BLOCK_NUMBERS, LEAF = 1 << 18, 48
#: What rounding may take from a bound, of the largest distance in it.
SLACK = 1e-9


def distances(points, entries):
    """Exact squared distances of whole-number vectors (n, k)."""
    size = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * size * size * points.shape[1] < 1 << 53 else np.int64  # floats are exact up to there
    a, b = points.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)


def lengths(points, center):
    apart = points - center
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


class Tree:
    """Balls over the distinct rows of whole-number `points`, and which row each point is.

    Ball k covers the rows lo[k] .. hi[k] of `rows`; its children, if any, come before it, the root last.
    """

    def __init__(self, points):
        rows, self.row, self.times = np.unique(points, axis=0, return_inverse=True, return_counts=True)
        self.row = self.row.reshape(-1)
        self.lo, self.hi, self.children, self.center, self.radius, self.sum, self.count = [], [], [], [], [], [], []
        self.rows, self.floats, self.order = rows, rows.astype(np.float64), []
        self.grow(np.arange(len(rows)))
        order = np.array(self.order)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.rows, self.times, self.row = rows[order], self.times[order], place[self.row]
        del self.floats, self.order

    def ball(self, members, children):
        """A new ball of the members, which are the last ones in `order`."""
        times = self.times[members]
        total = (self.rows[members] * times[:, None]).sum(0)
        center = total / times.sum()
        self.hi.append(len(self.order))
        self.lo.append(len(self.order) - len(members))
        self.children.append(children)
        self.center.append(center)
        self.radius.append(float(lengths(self.floats[members], center).max()))
        self.sum.append(total)
        self.count.append(int(times.sum()))
        return len(self.lo) - 1

    def grow(self, members):
        if len(members) <= LEAF:
            self.order += members.tolist()
            return self.ball(members, ())
        return self.join(self.anchors(members))

    def anchors(self, members):
        """The members, parted by the nearest of about sqrt(n) anchors.

        A new anchor is the point farthest from its own. From another it can only take points that are farther from
        that one than half the way between the two, and the points of an anchor lie in falling order of distance.
        """
        points = self.floats[members]
        far = lengths(points, points[0])
        order = np.argsort(-far, kind="stable")
        pivots, owned, dist = [points[0]], [order], [far[order]]
        for _ in range(1, int(np.ceil(np.sqrt(len(members))))):
            widest = max(range(len(dist)), key=lambda k: dist[k][0])
            pivot = points[owned[widest][0]]
            taken, their = [], []
            between = lengths(np.array(pivots), pivot)
            for k in range(len(pivots)):
                reach = int(np.searchsorted(-dist[k], -between[k] / 2 + SLACK * between[k], "right"))
                if not reach:
                    continue
                some = owned[k][:reach]
                new = lengths(points[some], pivot)
                goes = new < dist[k][:reach]
                if goes.any():
                    taken.append(some[goes])
                    their.append(new[goes])
                    stays = np.append(~goes, np.ones(len(owned[k]) - reach, bool))
                    owned[k], dist[k] = owned[k][stays], dist[k][stays]
            taken, their = np.concatenate(taken), np.concatenate(their)
            order = np.argsort(-their, kind="stable")
            pivots.append(pivot)
            owned.append(taken[order])
            dist.append(their[order])
        return [members[o] for o in owned if len(o)]

    def join(self, groups):
        """A ball of all groups: those are joined, two at a time, whose common ball is smallest, and built from the top."""
        sizes = np.array([self.times[g].sum() for g in groups], np.float64)
        centers = np.array([(self.floats[g] * self.times[g][:, None]).sum(0) for g in groups]) / sizes[:, None]
        radii = np.array([lengths(self.floats[g], c).max() for g, c in zip(groups, centers)])
        n = len(groups)
        cost = np.full((n, n), np.inf)

        def common(k):
            """Radius, at most, of the ball around the mean of k and each other."""
            mean = (centers * sizes[:, None] + centers[k] * sizes[k]) / (sizes + sizes[k])[:, None]
            return np.maximum(np.sqrt(((centers - mean) ** 2).sum(1)) + radii, np.sqrt(((centers[k] - mean) ** 2).sum(1)) + radii[k])

        alive, plan = np.ones(n, bool), list(range(n))
        for k in range(n):
            cost[k] = common(k)
        np.fill_diagonal(cost, np.inf)
        for _ in range(n - 1):
            i, j = np.unravel_index(np.argmin(cost), cost.shape)
            radius = cost[i, j]
            centers[i] = (centers[i] * sizes[i] + centers[j] * sizes[j]) / (sizes[i] + sizes[j])
            sizes[i], radii[i], plan[i], alive[j] = sizes[i] + sizes[j], radius, (plan[i], plan[j]), False
            cost[j], cost[:, j] = np.inf, np.inf
            cost[i] = np.where(alive, common(i), np.inf)
            cost[i, i] = np.inf
            cost[:, i] = cost[i]
        return self.build(plan[int(np.flatnonzero(alive)[0])], groups)

    def build(self, plan, groups):
        """The balls of a plan, a group or a pair of plans; without recursion in step with the pairs, which may be a long chain."""
        todo, made = [(plan, False)], []
        while todo:
            plan, ready = todo.pop()
            if isinstance(plan, int):
                made.append((self.grow(groups[plan]), groups[plan]) if len(groups) > 1 else self.leaf(groups[plan]))
            elif ready:
                (right, b), (left, a) = made.pop(), made.pop()
                both = np.concatenate([a, b])
                made.append((self.ball(both, (left, right)), both))
            else:
                todo += [(plan, True), (plan[1], False), (plan[0], False)]
        return made[0][0]

    def leaf(self, members):
        """A ball that could not be parted."""
        self.order += members.tolist()
        return self.ball(members, ()), members

    def owners(self, entries, between, each=False):
        """(sums, counts) of the points that are nearest to each entry, the first of equals.

        `between`: distances between the entries. With `each`, also entry and squared distance of every point.
        """
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        owner = np.empty(len(self.rows), np.int64)
        floats, todo = entries.astype(np.float64), [(len(self.lo) - 1, np.arange(len(entries)))]
        while todo:
            ball, left = todo.pop()
            if len(left) > 1:
                apart = floats[left] - self.center[ball]
                far = np.einsum("ij,ij->i", apart, apart)
                best = int(np.argmin(far))
                # By how much the entry is farther than the best one, at the point of the ball where it does best.
                left = left[far - far[best] <= 2 * self.radius[ball] * between[left[best], left] + SLACK * (far.max() + 1)]
            lo, hi = self.lo[ball], self.hi[ball]
            if len(left) == 1:
                sums[left[0]] += self.sum[ball]
                counts[left[0]] += self.count[ball]
                owner[lo:hi] = left[0]
            elif self.children[ball]:
                todo += [(child, left) for child in self.children[ball]]
            else:
                owner[lo:hi] = near = left[np.argmin(distances(self.rows[lo:hi], entries[left]), axis=1)]
                np.add.at(sums, near, self.rows[lo:hi] * self.times[lo:hi, None])
                np.add.at(counts, near, self.times[lo:hi])
        if not each:
            return sums, counts
        apart = self.rows - entries[owner]
        return sums, counts, owner[self.row], (apart * apart).sum(1)[self.row]


def spans(entries):
    """Distances between the entries of a codebook."""
    return np.sqrt(np.maximum(distances(entries, entries), 0).astype(np.float64))


def sound(vector):
    """Whether a vector is kept: not null, without null or non-finite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def bound(d):
    """The largest whole component for which squared distances of `d` of them fit 64 bits."""
    return int((1 << 30) / max(d, 1) ** 0.5)


def whole(vector, scale):
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def blocks(rows, d, parts):
    """(ids, labels, trees) of blocks of `rows` (vec_id, label, whole): a pickled tree per part."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    empty = rows.sparkSession.createDataFrame([], f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees array<binary>")
    schema, size = empty.toArrow().schema, max(64, BLOCK_NUMBERS // d)

    def block(table):
        points = table.column("whole").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(table.num_rows, parts, -1)
        trees = [pickle.dumps(Tree(np.ascontiguousarray(points[:, k])), protocol=5) for k in range(parts)]
        row = [[table.column(c).to_pylist()] for c in ("vec_id", "label")] + [[trees]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, schema.types)], schema=schema)

    def run(batches):
        kept("metrictree")
        held, n = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            while n >= size:
                table = pa.concat_tables(held)
                yield block(table.slice(0, size))
                held, n = [table.slice(size)], n - size
        if n:
            yield block(pa.concat_tables(held))

    return rows.mapInArrow(run, empty.schema)


def round_sums(trees, books):
    """{(part, entry): (sums, count)} of the points nearest to each entry; tasks add up, only entries are collected."""
    width = books.shape[2]

    def run(batches):
        own = [spans(book) for book in books]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in batch.column("trees"):
                for part, data in enumerate(row):
                    more, times = pickle.loads(data.as_py()).owners(books[part], own[part])
                    sums[part] += more
                    counts[part] += times
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"])

    found = trees.select("trees").mapInArrow(run, "part long, entry long, n long, sums array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums"))
    return {(r["part"], r["entry"]): (r["sums"], r["n"]) for r in found.collect()}


def assigned(trees, books, kinds):
    """(vec_id, label, code, error) of all vectors of the blocks."""
    digits = max(2, len(f"{books.shape[1] - 1:x}"))
    names = np.array([f"{k:0{digits}x}" for k in range(books.shape[1])], object)
    schema = pa.schema([("vec_id", kinds[0]), ("label", kinds[1]), ("code", pa.string()), ("error", pa.int64())])

    def run(batches):
        own = [spans(book) for book in books]
        for batch in batches:
            for ids, labels, row in zip(*(batch.column(c) for c in ("ids", "labels", "trees"))):
                code, error = "", 0
                for part, data in enumerate(row):
                    _, _, entry, far = pickle.loads(data.as_py()).owners(books[part], own[part], each=True)
                    code, error = code + names[entry], error + far
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(list(code), pa.string()), pa.array(error)], schema=schema)

    return run


def codebooks_digest(books):
    """sha256 of all components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE, vec_id="vec_id", vector="embedding", label="label"):
    """Codes of all vectors, and the codebooks: (rows, numpy array of (part, entry, component)).

    Columns of the rows, one per kept row: vec_id, label, code (entry of each part, two hex digits each), error (squared distances
    summed over the parts), label_error (error summed over rows of one label, nulls together), codebooks_sha256.

    Components x count as floor(scale * x). The codebooks start as the parts of the first vectors, by vec_id (nulls last),
    then components, and are fitted in `rounds` rounds: nearest entry, the first of equals, then floors of the means;
    an entry without points stays. Rows whose vector is null or has a null or non-finite component are dropped. A repeated row is
    a point of its own. With fewer vectors than `entries` the codebooks are shorter. A vector of another length than the first, or
    whose whole numbers pass `bound` (2^30 over the root of the length), takes no part: its row has a null code and error and
    adds nothing to the label's; vectors count as first if their length is a multiple of `parts` and not zero. Only the named columns are read. An empty table
    gives no rows.

    Vectors are not shuffled. The trees are a table in the shared folder, some 1.5 times the vectors' size, that each round reads;
    what is collected in a round is one row an entry.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(sound(F.col(vector)))
    rows = spread(rows).select("vec_id", "label", whole(F.col("vector"), scale).alias("whole"))
    first = [F.col("vec_id").asc_nulls_last(), "whole"]
    able = rows.filter((F.size("whole") > 0) & (F.size("whole") % parts == 0) & F.forall("whole", lambda x: F.abs(x) <= bound(parts)))
    lead = able.orderBy(*first).select(F.size("whole").alias("d")).head()
    d = lead["d"] if lead else parts
    alike = (F.size("whole") == d) & F.forall("whole", lambda x: x.between(-bound(d), bound(d)))
    fit = rows.filter(alike)
    start = fit.orderBy(*first).limit(entries).select("whole").collect()
    books = np.array([r["whole"] for r in start], np.int64).reshape(len(start), parts, d // parts).transpose(1, 0, 2).copy()
    other = rows.filter(~alike).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = other
    if len(start):
        trees = stored(blocks(fit.select("vec_id", "label", F.col("whole").cast("array<int>").alias("whole")), d, parts), "metric-trees")
        for _ in range(rounds):
            found = round_sums(trees, books)
            for (part, entry), (sums, n) in found.items():
                books[part, entry] = [x // n for x in sums]
        kinds = trees.limit(0).toArrow().schema
        run = assigned(trees, books, [kinds.field(c).type.value_type for c in ("ids", "labels")])
        coded = trees.mapInArrow(run, other.schema).union(other)
    coded = stored(coded, "codes-of-vectors")
    sums = stored(coded.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error")), "label-errors")
    joined = coded.alias("a").join(broadcast_if_small(sums).alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    out = joined.select("vec_id", "a.label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
    return out, books

"""Connected components of any size, and of any shape, by repeated joins."""

from pyspark.sql import functions as F

from claimloom.session import stored


def components(edges, max_rounds=100):
    """(node, root) for all nodes of `edges`, two columns of one type; root is the least node reachable.

    Alternates two steps until nothing changes: every node's larger neighbours are
    linked to its least neighbour, then its smaller ones are. A chain of n nodes takes
    about log(n) rounds. A hub is not gathered: its least neighbour is a grouped
    minimum, joined back. Each round is a table in the shared folder, so a lost
    executor costs one round at most. Null ends are ignored, and so are loops and repeats.
    """
    a, b = edges.columns
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
        .toDF("u", "v", "whole").filter("whole and u != v").select("u", "v").distinct(), "edges",
    )
    before = None
    for _ in range(max_rounds):
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            break
        before = size
        now = stored(small_star(large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def large_star(edges):
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def small_star(edges):
    """Links each smaller neighbour of a node, and the node, to the least of them; edges go from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).toDF("u", "v").filter("u != v").distinct()

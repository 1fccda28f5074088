"""Bounded samples that do not depend on order, files or tasks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Digests are numbers below this one.
DIGESTS = 1 << 62


def digest(*key):
    return F.pmod(F.xxhash64(*key), F.lit(DIGESTS))


def first_by_digest(rows, by, key, n):
    """Up to `n` rows of each value of `by`, those whose `key` has the lowest digests.

    Counts tell below which digest to look, so about twice `n` rows of a value are
    shuffled and ranked, however many there are. The number of values must be bounded.
    """
    counts = rows.groupBy(by).agg((F.lit(2.0 * n) / F.count("*") * DIGESTS).alias("_most"))
    near = rows.join(F.broadcast(counts), by).withColumn("_digest", digest(key))
    near = near.filter(F.col("_digest") < F.col("_most"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_digest", key))
    return near.withColumn("_place", place).filter(F.col("_place") <= n).select(rows.columns)

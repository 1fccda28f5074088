"""De-duplication and key joins between claim sets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom import schemas


def source_rank(priority=schemas.SOURCE_PRIORITY, column="data_source"):
    rank = F.lit(len(priority) + 1)
    for i, name in reversed(list(enumerate(priority, 1))):
        rank = F.when(F.col(column) == name, F.lit(i)).otherwise(rank)
    return rank


def default_order(df, keys=("language", "review_url")):
    """Source priority, review date, then every other column, so that the row that
    is kept does not depend on the order of arrival."""
    order = [source_rank()] if "data_source" in df.columns else []
    if "review_date" in df.columns:
        order.append(F.col("review_date").asc_nulls_last())
    rest = sorted(set(df.columns) - set(keys) - {"review_date", "data_source"})
    return order + [F.col(c).asc_nulls_first() for c in rest]


# Up to this many rows of a ranked group Spark limits it within the map tasks by itself.
MAP_SIDE_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
PARTS = 64


def top_k(df, by, order, k, rank="rank"):
    """First `k` rows per group with their rank.

    Spark limits each group within the map tasks first (WindowGroupLimit), so at
    most `k` rows per group and task are shuffled, however large the group is. For
    a large `k` it does not; then a group is first cut to its first `k` rows within
    each of 64 parts, whose union holds the result.
    """
    def first(rows, keys, name):
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)

    if k >= int(df.sparkSession.conf.get(MAP_SIDE_LIMIT)):
        parts = df.withColumn("_part", F.spark_partition_id() % PARTS)
        df = first(parts, [*by, "_part"], "_first").drop("_part", "_first")
    return first(df, by, rank)


def dedupe_by_url(df, keys=("language", "review_url"), order=None):
    """One row per key; rows without a URL are all kept.

    One pass: a number of its own makes each row without a URL a group of its own, so
    such rows are spread over all tasks however many there are.
    """
    own = F.when(F.col(keys[-1]).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    ordered = order or default_order(df, keys)
    return top_k(df.withColumn("_own", own), [*keys, "_own"], ordered, 1, rank="_rank").drop("_rank", "_own")


# Digests of so many keys, 8 bytes each, are broadcast at most.
MAX_KEYS = 2_000_000


def skip_collected(new, done, key="review_url"):
    """Rows of `new` whose key is not in `done`; null keys are kept.

    `done` grows without bound and `new` is mostly a batch. So the keys of `done` are
    first cut to those whose digest occurs in `new`. The digests of a batch of up to MAX_KEYS keys
    are broadcast: `done` is then read by its key column and never shuffled, and only what
    passes meets the batch, key by key. Beyond that both sides are shuffled, and AQE splits skewed partitions.
    """
    digest = F.xxhash64(key).alias("_digest")
    wanted = new.filter(F.col(key).isNotNull()).select(digest).distinct()
    if wanted.limit(MAX_KEYS + 1).count() <= MAX_KEYS:
        wanted = F.broadcast(wanted)
    known = done.select(key, digest).join(wanted, "_digest", "left_semi").select(key).distinct()
    return new.join(known, key, "left_anti")


def source_overlap(df):
    """URLs found in more than one source, with the sources in order.

    Counting per (language, URL, source) first leaves one row per source and URL.
    """
    per_source = (
        df.filter(F.col("review_url").isNotNull())
        .groupBy("language", "review_url", "data_source")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return (
        per_source.groupBy("language", "review_url")
        .agg(
            F.array_join(F.array_sort(F.collect_set("data_source")), ",").alias("sources"),
            F.count("data_source").alias("source_count"),
            F.sum("rows").alias("rows"),
        )
        .filter(F.col("source_count") > 1)
    )


def overlap_rows(df):
    """Rows whose URL is in more than one source."""
    shared = source_overlap(df).select("language", "review_url")
    same = F.col("d.language").eqNullSafe(F.col("s.language")) & (
        F.col("d.review_url") == F.col("s.review_url")
    )
    return df.alias("d").join(shared.alias("s"), same, "left_semi")


def missing_from(full, snapshot):
    """Rows of `snapshot` that `full` lacks, as a multiset on the shared columns."""
    shared = [c for c in snapshot.columns if c in full.columns]
    return snapshot.select(*shared).exceptAll(full.select(*shared))

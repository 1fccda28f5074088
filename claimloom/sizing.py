"""Broadcast only what has been measured to be small."""

from pyspark.sql import functions as F

MAX_ROWS = 100_000
MAX_BYTES = 32 * 1024 * 1024


def is_small(df, max_rows=MAX_ROWS, max_bytes=MAX_BYTES):
    """Whether `df` is within both bounds.

    `take` scans partitions step by step and stops at the bound, so a large table
    is not read through; one number per row, at most `max_rows + 1`, is returned.
    Pass rows as they are stored: a `distinct` before the probe would run in full.
    """
    width = sum(
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns),
        F.lit(16),
    )
    widths = df.select(width.alias("width")).take(max_rows + 1)
    return len(widths) <= max_rows and sum(r["width"] for r in widths) <= max_bytes


def broadcast_if_small(df, max_rows=MAX_ROWS, max_bytes=MAX_BYTES):
    """Hint a broadcast when `df` is measured to be small, else return it as is.

    Beyond the bounds the join is left to Catalyst and AQE, which shuffle it and
    split skewed partitions.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def spread(df, *keys):
    """Spread a scan that has fewer partitions than the session has cores.

    A small table may be one row group, which is one task however heavy the text
    work behind it. Inputs with enough partitions are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df

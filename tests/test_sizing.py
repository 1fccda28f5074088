"""The size check before a broadcast."""

from pyspark.sql import functions as F

from claimloom import sizing


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()


def test_row_and_byte_bounds(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("a"), F.lit(None).cast("int").alias("b"))
    assert sizing.is_small(df)
    assert not sizing.is_small(df, max_rows=99)
    assert not sizing.is_small(df, max_bytes=100_000)
    assert hinted(sizing.broadcast_if_small(df))
    assert not hinted(sizing.broadcast_if_small(df, max_rows=99))


def test_probe_stops_early(spark):
    """A probe of a large table reads a part of it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 2_000_000, numPartitions=64).mapInArrow(count, "id long")
    assert not sizing.is_small(df, max_rows=1000)
    assert seen.value < 200_000


def test_spread_leaves_large_inputs_alone(spark):
    many = spark.range(0, 100, numPartitions=64)
    assert sizing.spread(many, "id") is many
    assert sizing.spread(many.coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism

"""The key index of incremental tables: what it reads, and what crashes leave."""

import shutil

import pytest
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.session import new_path
from claimloom.streaming import ingest, keyindex
from claimloom.streaming.ingest import KEY


@pytest.fixture
def table(spark):
    path = new_path(spark, "indexed-table")
    ingest.create_table(spark, "review_url string, n long, record_key string", path)
    return path


def batch(spark, start, end):
    return spark.range(start, end).select(F.concat(F.lit("https://a.org/"), "id").alias("review_url"), F.col("id").alias("n"))


def urls(spark, path):
    return sorted(r["n"] for r in spark.read.schema("n long").parquet(path).collect())


def index(spark, path):
    return keyindex.KeyIndex(spark, path, KEY)


def keyed(df):
    return df.withColumn(KEY, ingest.record_key(df.columns))


def test_batches_and_replays(spark, table):
    for start, end in ((0, 50), (30, 80), (0, 80), (200, 210)):
        ingest.append_new(batch(spark, start, end), table)
    assert urls(spark, table) == [*range(80), *range(200, 210)]


def test_a_batch_reads_its_buckets_only(spark, table, monkeypatch):
    """With ten times the rows a batch of five keys reads no more than five buckets of the same size."""
    monkeypatch.setattr(keyindex, "PER_BUCKET", 20)
    most, few = [], batch(spark, 10**6, 10**6 + 5)
    for start, end in ((0, 300), (300, 3000)):
        ingest.append_new(batch(spark, start, end), table)
        near = index(spark, table).known_near(keyed(few))
        most.append(near.count())
        assert index(spark, table).generations()[-1][1] >= (end // 20).bit_length() - 1
        assert 0 <= most[-1] <= 5 * 3 * 20
    ingest.append_new(batch(spark, 2990, 3010), table)
    assert urls(spark, table) == list(range(3010))
    files = [f for f in index(spark, table).known_near(keyed(few)).inputFiles()]
    assert all("/bucket=" in f for f in files)


def test_one_generation_is_left(spark, table, monkeypatch):
    monkeypatch.setattr(keyindex, "ADDITIONS", 3)
    for k in range(7):
        ingest.append_new(batch(spark, 10 * k, 10 * k + 12), table)
    assert len(index(spark, table).generations()) == 1 and urls(spark, table) == list(range(72))
    now = index(spark, table).refresh()
    assert index(spark, table).keys(now).count() == 72


def test_a_crash_between_table_and_index(spark, table):
    """Rows that were committed but not indexed are taken in before the next batch."""
    ingest.append_new(batch(spark, 0, 20), table)
    keyed(batch(spark, 20, 40)).write.mode("append").parquet(table)  # the index was not told
    ingest.append_new(batch(spark, 10, 50), table)
    assert urls(spark, table) == list(range(50))


def test_a_crash_within_the_index(spark, table):
    """Keys without their file's mark are taken in again, a generation without its marks is none, a lost index is made anew."""
    ingest.append_new(batch(spark, 0, 30), table)
    own = index(spark, table)
    now = own.refresh()
    own._write(keyed(batch(spark, 0, 30)), now)
    own._write(keyed(batch(spark, 5, 9)), (now[0] + 1, now[1] + 3))
    ingest.append_new(batch(spark, 0, 35), table)
    assert urls(spark, table) == list(range(35))
    shutil.rmtree(own.path.removeprefix("file:"))
    ingest.append_new(batch(spark, 0, 36), table)
    assert urls(spark, table) == list(range(36))


def test_rows_without_a_url(spark, table):
    rows = spark.createDataFrame([(None, 1), (None, 1), (None, 2)], "review_url string, n long")
    for _ in range(2):
        ingest.append_new(rows, table)
    assert urls(spark, table) == [1, 2]


def test_claims_stream(spark):
    src, path, ckpt = (new_path(spark, f"key-{n}") for n in ("src", "table", "ckpt"))
    rows = [tuple(f"{c}{i}" for c in schemas.RAW_COLUMNS) for i in range(30)]
    spark.createDataFrame(rows, schemas.RAW).repartition(3).write.parquet(src)
    for _ in range(2):
        ingest.ingest_stream(spark, src, path, ckpt + str(_), files_per_batch=1).awaitTermination()
    assert spark.read.parquet(path).count() == 30

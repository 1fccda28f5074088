"""Incremental collection: landed files → table, each record once.

The checkpoint knows which files were read; the record key makes a replayed batch
harmless. A record with a URL is keyed by it, one without by a digest of the row.
Uniqueness has to hold over all history, so no watermark bounds it.
"""

from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import schemas
from claimloom.operators.dedupe import default_order, skip_collected, top_k
from claimloom.operators.extract import extract_claims
from claimloom.sources.scans import flatten_responses, response_rejects
from claimloom.streaming.keyindex import KeyIndex

KEY = "record_key"
# Bounds a micro-batch.
FILES_PER_BATCH = 1000
KEY_FIELD = T.StructField(KEY, T.StringType())


def record_key(columns, url="review_url"):
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    return F.when(F.col(url).isNotNull(), F.concat(F.lit("u:"), url)).otherwise(
        F.concat(F.lit("h:"), digest)
    )


def claim_key(columns, url="review_url"):
    """Key of an extracted claim; one page may state several claims."""
    return F.sha2(F.to_json(F.struct(url, "claim_text")), 256)


def create_table(spark, schema, table):
    """An empty table where there is none yet."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(table)


def append_new(batch, table, key=record_key):
    """Append the rows of `batch` that the table lacks.

    The keys of the table are looked up in its index, of which only the buckets of the batch are read.
    """
    spark = batch.sparkSession
    keyed = batch.withColumn(KEY, key(batch.columns))
    first = top_k(keyed, [KEY], default_order(keyed, (KEY,)), 1, rank="_rank").drop("_rank")
    first = first.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        done = KeyIndex(spark, table, KEY).known_near(first)
        skip_collected(first, done, KEY).select(*first.columns).write.mode("append").parquet(table)
    finally:
        first.unpersist()


def _run(stream, table, checkpoint, key, transform):
    return (
        stream.writeStream.foreachBatch(
            lambda batch, _: append_new(transform(batch), table, key)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _source(spark, src, schema, files_per_batch):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(src)


def ingest_stream(spark, src, table, checkpoint, schema=schemas.RAW, files_per_batch=FILES_PER_BATCH):
    """Landed claim files not read before; URLs already stored are skipped."""
    create_table(spark, T.StructType([*schema.fields, KEY_FIELD]), table)
    stream = _source(spark, src, schema, files_per_batch)
    return _run(stream, table, checkpoint, record_key, lambda df: df)


def whole_row(columns):
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def response_stream(spark, src, table, checkpoint, rejects, files_per_batch=FILES_PER_BATCH):
    """Claims of landed search responses not read before: (matched_query, response).

    Responses that hold no answer go to the table `rejects` with the reason, in the same micro-batch.
    """
    create_table(spark, T.StructType([*schemas.RAW.fields, KEY_FIELD]), table)
    create_table(spark, T.StructType([*schemas.REJECT.fields, KEY_FIELD]), rejects)
    stream = _source(spark, src, schemas.strings(["matched_query", "response"]), files_per_batch)

    def transform(batch):
        append_new(response_rejects(batch), rejects, whole_row)
        return flatten_responses(batch)

    return _run(stream, table, checkpoint, record_key, transform)


def extract_stream(spark, src, table, checkpoint, language=None, files_per_batch=FILES_PER_BATCH):
    """Claims of landed pages not read before."""
    create_table(spark, T.StructType([*schemas.SCRAPED.fields, KEY_FIELD]), table)
    stream = _source(spark, src, schemas.PAGE, files_per_batch)
    return _run(stream, table, checkpoint, claim_key, lambda df: extract_claims(df, language))

"""Sinks. Each writes in parallel with Spark's own job commit."""

import uuid

from pyspark.sql import functions as F

from claimloom.operators.clean import align
from claimloom import schemas


def append_claims(df, table):
    """Append to a Parquet table. Files show up only when the job commits, so a
    crash leaves what earlier appends wrote."""
    df.write.mode("append").parquet(table)


def append_snapshot(df, table):
    """Append to a table whose readers see whole appends only.

    The rows go to a folder of their own, and one row in one file then names it: as long as that file is
    not there, `read_snapshot` knows nothing of the folder, whichever of its files are. Appends that run at once do not meet.
    """
    part = uuid.uuid4().hex
    df.write.parquet(f"{table}/data/{part}")
    commit = df.sparkSession.createDataFrame([(part,)], "part string").coalesce(1)
    commit.write.mode("append").parquet(f"{table}/commits")


def read_snapshot(spark, table, schema):
    """The rows of all whole appends; what was not committed when this is called is not read. One name an append comes to the driver."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/commits")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    parts = [r["part"] for r in spark.read.schema("part string").parquet(f"{table}/commits").collect()]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{table}/data/{part}" for part in sorted(parts)))


# Written so that every value reads back as it was; only null and empty become one.
CSV = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _write(df, path, by, format):
    options = CSV if format == "csv" else {}
    df.write.mode("overwrite").partitionBy(by).format(format).options(**options).save(path)


def read_written(spark, path, schema, format="parquet"):
    """What one of the sinks wrote, as Parquet or CSV."""
    options = {**CSV, "multiLine": True} if format == "csv" else {}
    return spark.read.schema(schema).format(format).options(**options).load(path)


def write_by_language(df, path, format="parquet"):
    """One partition folder per language, as Parquet or CSV.

    Each task writes its own file per language: no shuffle by language, which
    would put the largest language into one task.
    """
    _write(df, path, "language", format)


def write_qc(df, path, flag="is_boilerplate", format="parquet"):
    """Clean copy and flagged rows, under `clean` and `flagged`.

    One pass: the flag becomes the partition folder.
    """
    kind = F.when(F.col(flag), "flagged").otherwise("clean")
    _write(df.withColumn("part", kind), path, "part", format)


def read_qc(spark, path, part, schema, format="parquet"):
    return read_written(spark, f"{path}/part={part}", schema, format)


def write_merged(df, path, format="parquet"):
    """Final per-language files with the 22 merged columns."""
    write_by_language(align(df, schemas.MERGED), path, format)


def write_phrases(df, path):
    """Phrase lists as CSV, one folder `list={lang}_{method}` each."""
    name = F.concat_ws("_", "lang", "method")
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.PHRASE.fields
    ]
    (
        df.select(*columns, name.alias("list"))
        .write.mode("overwrite")
        .partitionBy("list")
        .options(escape='"', header=True)
        .csv(path)
    )

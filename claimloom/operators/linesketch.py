"""The line cap of a corpus that grows: each landing is read once.

A landing leaves behind a sketch, its lines with the lowest digests. The lowest of all
landings are among those of the sketches, so the sample of the whole is made from these
and no landing is read again.
"""

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.operators.phrases import line_digest, sample_lines
from claimloom.session import stored


def _has(spark, folder):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return any(files.exists(status.getPath().suffix("/_SUCCESS")) for status in files.globStatus(path) or [])


def line_sketch(df, n=300_000, key="text", languages=schemas.LANGUAGES, bounds=None):
    """What `sample_lines` returns but for lines that the whole corpus cannot take in.

    `bounds`: {language: highest digest that may come in}. Lines of these languages are compared with their bound in the
    scan, and the few below it are written and cut to `n`; lines of other languages go through `sample_lines`.
    """
    open_ones = [lang for lang in languages if lang not in (bounds or {})]
    parts = [sample_lines(df, n, key, open_ones)] if open_ones else []
    if bounds:
        low = F.lit(False)
        for lang, most in bounds.items():
            low = low | ((F.col("lang") == lang) & (line_digest("lang", key) <= most))
        parts.append(sample_lines(stored(df.filter(F.col("lang").isin(*bounds) & low), "low-lines"), n, key, tuple(bounds)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def add_lines(df, name, path, n=300_000, key="text", languages=schemas.LANGUAGES):
    """Writes the sketch of a landing under its name; it is written again only with the same lines.

    Once the sketches hold `n` lines of a language, the n-th lowest digest bounds what can still come in: a new landing is read
    once, and only its lines up to the bound are written, a part that shrinks as the corpus grows.
    """
    spark, bounds = df.sparkSession, {}
    if _has(spark, f"{path}/n={n}/landing=*"):
        others = _sketches(spark, path, n).filter(F.col("landing") != name).drop("landing")
        capped = sample_lines(others, n, key, languages).withColumn("digest", line_digest("lang", key))
        found = capped.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.max("digest").alias("most")).filter(F.col("lines") >= n)
        # One row per language of `languages`.
        bounds = {r["lang"]: r["most"] for r in found.collect()}
    line_sketch(df, n, key, languages, bounds).write.mode("overwrite").parquet(f"{path}/n={n}/landing={name}")


def _sketches(spark, path, n):
    read = spark.read.option("basePath", f"{path}/n={n}").parquet(f"{path}/n={n}")
    return read.withColumn("landing", F.col("landing").cast("string"))


def capped_lines(spark, path, n=300_000, key="text", languages=schemas.LANGUAGES):
    """The `n` lowest lines per language of all landings, from their sketches."""
    return sample_lines(_sketches(spark, path, n).drop("landing"), n, key, languages)

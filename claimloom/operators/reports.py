"""Accounting and report aggregations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.operators.clean import row_kind


def _pct(part, whole):
    return F.round(part * F.lit(100.0) / F.when(whole != 0, whole), 1)


def with_share(df, column, by=()):
    """Add `share`: percent of the total of `column` (per `by`).

    For aggregated frames only: without `by`, the window is one task.
    """
    total = F.sum(column).over(Window.partitionBy(*by))
    return df.withColumn("share", _pct(F.col(column), total))


def merge_summary(before, existing=schemas.EXTERNAL, archive=schemas.ARCHIVE):
    """Accounting of a URL merge per language, from the rows before it.

    Rows of the existing set, of the archive, without a source and of all others (the
    search interface) are counted apart; they add up to `final_rows` and the duplicates removed.

    Counting per (language, URL) gives the same figures as counting the merged
    rows, with partial sums in the map tasks and no sort: `final_rows` is the
    number of distinct URLs plus the rows without a URL. The figures of rows added
    are those before de-duplication.
    """
    source = F.col("data_source")
    counts = {
        "existing_rows": F.count_if(source == existing),
        "api_rows_added": F.count_if((source != existing) & (source != archive)),
        "archive_rows_added": F.count_if(source == archive),
        "unlabelled_rows": F.count_if(source.isNull()),
    }
    per_url = before.groupBy("language", "review_url").agg(*(c.alias(n) for n, c in counts.items()))
    rows = sum((F.col(n) for n in counts), F.lit(0))
    kept = F.when(F.col("review_url").isNull(), rows).otherwise(1)
    totals = per_url.groupBy("language").agg(
        *(F.sum(n).alias(n) for n in counts), F.sum(kept).alias("final_rows"),
    )
    removed = rows - F.col("final_rows")
    gained = F.col("final_rows") - F.col("existing_rows")
    return totals.select(
        "language",
        *counts,
        removed.alias("duplicates_removed"),
        "final_rows",
        _pct(gained, F.col("existing_rows")).alias("growth"),
    )


def corruption_report(df):
    """Total rows, shifted rows and their share, and malformed rows of a ragged scan."""
    last = [c for c in df.columns if c != schemas.CORRUPT][-1]  # null in a row that lacks a field
    counts = df.select(row_kind().alias("kind"), F.col(last).alias("last")).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if((F.col("kind") == "shifted") & F.col("last").isNull()).alias("shifted_rows"),
        F.count_if(~F.col("kind").isin("complete", "shifted")).alias("malformed_rows"),
    )
    return counts.withColumn("share", _pct(F.col("shifted_rows"), F.col("total_rows")))


def size_table(df, languages=schemas.LANGUAGES):
    """Rows per source, one column per language."""
    return df.groupBy("data_source").agg(*[
        F.count_if(F.col("language") == lang).alias(lang) for lang in languages
    ])


def extraction_mix(df):
    """Rows and share per extraction method; no claim counts as `none`."""
    method = F.coalesce("extraction_method", F.lit("none")).alias("extraction_method")
    return with_share(df.groupBy(method).agg(F.count(F.lit(1)).alias("rows")), "rows")


def qc_report(df, by=("language", "publisher_site")):
    """Rows and flagged rows per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_boilerplate").alias("flagged")
    )


def flagged_urls(df):
    """Addresses of flagged rows, to be reviewed by hand."""
    return df.filter("is_boilerplate").select("review_url").distinct()


def uniqueness(df, url="review_url", approximate=False):
    """Rows, distinct rows and distinct URLs of a snapshot.

    Rows are told apart by a 256-bit digest, so that the shuffle carries 32 bytes
    per row and not its text.
    """
    if approximate:
        row = F.xxhash64(*df.columns)
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.approx_count_distinct(row).alias("unique_rows"),
            F.approx_count_distinct(url).alias("unique_urls"),
        )
    digest = F.unhex(F.sha2(F.to_json(F.struct(*df.columns)), 256))
    per_row = df.groupBy(digest.alias("digest"), F.col(url).alias("url")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_url = per_row.groupBy("url").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("digests")
    )
    return per_url.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("digests"), F.lit(0)).alias("unique_rows"),
        F.count("url").alias("unique_urls"),
    )


# Size of a distinct sketch, as a power of two; its standard error is about 0.65 %.
SKETCH_BITS = 14


def landing_sketches(df, by=(), url="review_url"):
    """Per landing, told by the columns `by`: rows, and mergeable sketches of its distinct rows and URLs.

    Kept with each landing, they tell the unique rows of all landings so far without reading those again. A sketch has a
    few KB however many rows there are; null URLs are none. Rows are compared by all columns but `by`, through 64-bit digests.
    """
    row = F.xxhash64(*(c for c in df.columns if c not in by))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(row, SKETCH_BITS).alias("row_sketch"),
        F.hll_sketch_agg(url, SKETCH_BITS).alias("url_sketch"),
    )


def merged_uniqueness(sketches):
    """`uniqueness` of all landings from their sketches: `rows` exactly, the others within 2 % (three standard errors)."""
    estimate = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0).cast("long"))
    return sketches.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), estimate("row_sketch").alias("unique_rows"),
        estimate("url_sketch").alias("unique_urls"),
    )


def add_landing(df, name, path, url="review_url"):
    """Writes the sketches of a landing under its name; written again, they replace the ones before."""
    landing_sketches(df, url=url).write.mode("overwrite").parquet(f"{path}/landing={name}")


def yield_ratio(df, archive=schemas.ARCHIVE, api=schemas.API):
    """Archive rows over API rows per language."""
    counts = df.groupBy("language").agg(
        F.count_if(F.col("data_source") == archive).alias("archive_rows"),
        F.count_if(F.col("data_source") == api).alias("api_rows"),
    )
    api_rows = F.when(F.col("api_rows") != 0, F.col("api_rows"))
    return counts.withColumn("ratio", F.round(F.col("archive_rows") / api_rows, 2))


def language_balance(df, by="query_lang"):
    """Share of each result language per query language (or query)."""
    counts = df.groupBy(by, "language").agg(F.count(F.lit(1)).alias("rows"))
    return with_share(counts, "rows", (by,))

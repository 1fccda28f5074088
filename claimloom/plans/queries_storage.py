"""Queries that write to the shared folder and read back: scans, sinks, streams."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import schemas
from claimloom.operators import clean, reports
from claimloom.plans import archive, views
from claimloom.plans.merge import merge_claims
from claimloom.plans.queries_claims import KEPT, KEPT_SQL, MERGED_SQL, PRIORITY, RAW, TIES, merged
from claimloom.plans.queries_pages import BOILERPLATE_TEXT, C, E
from claimloom.plans.queries_text import (
    FREQUENT, LINES, MERGED_YAKE, PICKED, TOP, YP,
    corpus_lines, frequent, phrase_scores, stopwords,
)
from claimloom.operators.yake import merge_yake
from claimloom.plans.views import with_views
from claimloom.session import new_path
from claimloom.sources import scans, sinks
from claimloom.streaming import ingest

WIDE = ", ".join(schemas.WIDE_COLUMNS)
SOURCED = T.StructType([*schemas.RAW.fields, T.StructField("data_source", T.StringType())])


def claims_csv(spark, sf):
    path = new_path(spark, "claims-csv")
    (
        views.claims(spark, sf).select(*schemas.RAW_COLUMNS)
        .write.options(escape='"', header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )
    return scans.read_claims(spark, path).select(*schemas.RAW_COLUMNS, F.col(schemas.CORRUPT).isNotNull().alias("is_malformed"))


def broken_csv(spark, sf):
    """Whole documents as CSV, whose texts hold line breaks and quotes, read by splits."""
    path = new_path(spark, "documents-csv")
    docs = views.documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.col("text"), F.lit('"\n"end')).alias("text"), "lang")
    docs.write.options(escape='"', header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return scans.read_claims(spark, path, ["doc_id", "text", "lang"]).drop(schemas.CORRUPT)


def reordered_csv(spark, sf):
    """The claims under a header in another order, with a column that is not asked for."""
    path = new_path(spark, "claims-reordered")
    turned = views.claims(spark, sf).select("doc_id", *reversed(schemas.RAW_COLUMNS))
    turned.write.options(escape='"', header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return scans.read_claims(spark, path).drop(schemas.CORRUPT)


def mixed_merge(spark, sf):
    """The mixed file put right and merged."""
    fixed = clean.repair_shift(ragged_csv(spark, sf))
    return merge_claims([fixed.withColumn("data_source", F.lit(schemas.API))])


def merged_csv(spark, sf):
    path = new_path(spark, "merged-csv")
    sinks.write_merged(merged(spark, sf), path, "csv")
    return sinks.read_written(spark, path, schemas.MERGED, "csv")


def ragged_csv(spark, sf):
    """Three rows in four in the older layout, under the newer header."""
    wide = views.wide_claims(spark, sf)
    options = {
        "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    old = [c for c in schemas.WIDE_COLUMNS if c != "query_lang"]
    line = F.when(
        F.col("doc_id") % 4 != 0, F.to_csv(F.struct(*old), options)
    ).otherwise(F.to_csv(F.struct(*schemas.WIDE_COLUMNS), options))
    path = new_path(spark, "ragged-csv")
    wide.select(line.alias("value")).write.text(path)
    return scans.read_claims_ragged(spark, path, header=False)


def appended(spark, sf):
    table = new_path(spark, "claims-table")
    claims = views.claims(spark, sf)
    sinks.append_claims(claims.filter(F.col("data_source") == schemas.EXTERNAL), table)
    sinks.append_claims(claims.filter(F.col("data_source") != schemas.EXTERNAL), table)
    return spark.read.schema(claims.schema).parquet(table)


def snapshots(spark, sf):
    """Two whole appends, and between them one whose writer stopped before it was committed."""
    table, claims = new_path(spark, "snapshots"), views.claims(spark, sf)
    sinks.append_snapshot(claims.filter(F.col("data_source") == schemas.EXTERNAL), table)
    claims.write.parquet(f"{table}/data/stopped")
    sinks.append_snapshot(claims.filter(F.col("data_source") != schemas.EXTERNAL), table)
    return sinks.read_snapshot(spark, table, claims.schema)


def split_by_language(spark, sf):
    path = new_path(spark, "by-language")
    kept = clean.rename_query(clean.keep_languages(views.claims(spark, sf)))
    sinks.write_by_language(kept, path)
    return spark.read.schema(kept.schema).parquet(path)


def qc_split(spark, sf):
    path = new_path(spark, "qc")
    flagged = archive.archive_claims(views.claim_pages(spark, sf))
    sinks.write_qc(flagged, path)
    parts = [
        sinks.read_qc(spark, path, part, flagged.schema).withColumn("part", F.lit(part))
        for part in ("clean", "flagged")
    ]
    return parts[0].unionByName(parts[1])


def merged_files(spark, sf):
    path = new_path(spark, "merged")
    sinks.write_merged(merged(spark, sf), path)
    return spark.read.schema(schemas.MERGED).parquet(path)


def phrase_files(spark, sf):
    path, stop = new_path(spark, "phrases"), stopwords(spark, sf)
    counted = frequent(spark, sf, stop).withColumn("method", F.lit("frequent_ngrams"))
    scored = merge_yake(phrase_scores(spark, sf, stop), TOP).withColumn("method", F.lit("yake_phrases"))
    sinks.write_phrases(
        counted.unionByName(scored.drop("batches"), allowMissingColumns=True), path
    )
    return path


def ingested(spark, sf):
    """Two landings, the second one holding the first again."""
    src, table, ckpt = (new_path(spark, f"ingest-{n}") for n in ("landing", "table", "ckpt"))
    claims = views.claims(spark, sf).drop("doc_id")
    for part in (claims.filter(F.col("data_source") != schemas.API), claims):
        part.write.mode("append").parquet(src)
        ingest.ingest_stream(spark, src, table, ckpt, SOURCED).awaitTermination()
    return spark.read.schema(SOURCED).parquet(table)


def extracted_stream(spark, sf):
    src, table, ckpt = (new_path(spark, f"pages-{n}") for n in ("landing", "table", "ckpt"))
    pages = views.claim_pages(spark, sf)
    labelled = views.table(spark, sf, "labels").select(F.col("doc_id").alias("page_id")).distinct()
    for part in (pages.join(labelled, "page_id", "left_semi"), pages):
        part.write.mode("append").parquet(src)
        ingest.extract_stream(spark, src, table, ckpt).awaitTermination()
    return spark.read.schema(schemas.SCRAPED).parquet(table)


REPAIRED_SQL = (
    f"select {WIDE.replace('query_lang', 'case when doc_id % 4 <> 0 then null else query_lang end as query_lang')} "
    "from wide_csv_v"
)
INGESTED_SQL = (
    f"select {RAW}, data_source from (select *, row_number() over (partition by review_url order by "
    f"case when data_source = 'google_factcheck_api' then 1 else 0 end, {PRIORITY}, {TIES}) as rn "
    "from claims_v) where rn = 1 or review_url is null"
)

CSV_CLAIMS_SQL = f"select * replace (nullif(claim_date, '') as claim_date) from (select {RAW} from claims_v)"
MIXED = ("mixed_v", (
    f"select {RAW}, 'google_factcheck_api' as data_source from (select *, query as matched_query from wide_csv_v)"
))

QUERIES = {
    "claims_csv_scan": (claims_csv, with_views(f"select *, false as is_malformed from ({CSV_CLAIMS_SQL})")),
    "csv_quoted_breaks": (broken_csv, "select cast(doc_id as varchar) as doc_id, concat(text, '\"', chr(10), '\"end') as text, lang from documents"),
    "claims_csv_by_name": (reordered_csv, with_views(CSV_CLAIMS_SQL)),
    "mixed_layout_merge": (mixed_merge, with_views(
        MERGED_SQL, MIXED, ("claims_kept", KEPT_SQL.replace("claims_v", "mixed_v")), ("kept_v", "select * from claims_kept"),
    )),
    "merged_csv_output": (merged_csv, with_views(
        "select * replace (nullif(claim_text, '') as claim_text, nullif(claim_date, '') as claim_date) from "
        f"({MERGED_SQL})", ("claims_kept", KEPT_SQL), ("kept_v", "select * from claims_kept"),
    )),
    "ragged_csv_scan": (
        lambda s, d: ragged_csv(s, d).select(
            *schemas.WIDE_COLUMNS, F.col(schemas.CORRUPT).isNotNull().alias("is_short")
        ),
        with_views(f"select {WIDE}, s as is_short from shifted_v"),
    ),
    "shifted_row_predicate": (
        lambda s, d: clean.is_shifted(ragged_csv(s, d)).select("query", "query_lang", "is_shifted"),
        with_views("select query, query_lang, s as is_shifted from shifted_v"),
    ),
    "shifted_row_repair": (
        lambda s, d: clean.repair_shift(ragged_csv(s, d)), with_views(REPAIRED_SQL),
    ),
    "corruption_report": (
        lambda s, d: reports.corruption_report(ragged_csv(s, d)),
        with_views(
            "select count(*) as total_rows, count(*) filter (s) as shifted_rows, cast(0 as bigint) as malformed_rows, "
            "round(count(*) filter (s) * 100.0 / count(*), 1) as share from shifted_v"
        ),
    ),
    "corpus_scan": (
        corpus_lines, with_views("select lang, md5(concat(lang, ':', text)) as line_id, text from lines_v", LINES),
    ),
    "snapshot_append": (snapshots, with_views("select * from claims_v")),
    "crash_safe_append": (appended, with_views("select * from claims_v")),
    "language_split_output": (
        split_by_language,
        with_views(f"select * exclude (matched_query), matched_query as query from claims_v where {KEPT}"),
    ),
    "qc_output": (
        qc_split,
        with_views(
            f"select *, claim_text = '{BOILERPLATE_TEXT}' as is_boilerplate, case when claim_text = "
            f"'{BOILERPLATE_TEXT}' then 'flagged' else 'clean' end as part from extracted_v", E, C,
        ),
    ),
    "merged_output": (
        merged_files, with_views(MERGED_SQL, ("claims_kept", KEPT_SQL), ("kept_v", "select * from claims_kept")),
    ),
    "phrase_list_output": (
        lambda s, d: scans.read_phrases(s, phrase_files(s, d)),
        with_views(
            "select lang, 'frequent_ngrams' as method, phrase, n, freq, cast(null as double) as score, rank "
            "from top_v union all select lang, 'yake_phrases', phrase, null, null, score, rank from yake_v",
            *YP, *FREQUENT, MERGED_YAKE,
        ),
    ),
    "phrase_list_scan": (
        lambda s, d: scans.read_phrases(s, phrase_files(s, d)).groupBy("lang", "method").agg(
            F.count(F.lit(1)).alias("rows"), F.max("rank").alias("last_rank")
        ),
        with_views(
            "select lang, method, count(*) as rows, max(rank) as last_rank from picked_v group by 1, 2",
            *YP, *FREQUENT, MERGED_YAKE, PICKED,
        ),
    ),
    "incremental_claim_ingest": (ingested, with_views(INGESTED_SQL)),
    "incremental_page_extraction": (extracted_stream, with_views("select * from extracted_v", E, C)),
}

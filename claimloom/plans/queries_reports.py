"""Accounting and report queries."""

from pyspark.sql import functions as F

from claimloom.operators import clean, reports
from claimloom.operators.extract import extract_claims
from claimloom.plans import archive, merge, views
from claimloom.plans.queries_claims import KEPT, by_source
from claimloom.plans.queries_pages import BOILERPLATE_TEXT, C, E
from claimloom.plans.views import with_views
from claimloom.session import stored

SUMMARY_SQL = (
    "select language, existing_rows, api_rows_added, archive_rows_added, unlabelled_rows, existing_rows + "
    "api_rows_added + archive_rows_added + unlabelled_rows - final_rows as duplicates_removed, final_rows, round((final_rows - existing_rows) * 100.0 / "
    "nullif(existing_rows, 0), 1) as growth from (select language, "
    "count(*) filter (data_source = 'xfact_2021') as existing_rows, "
    "count(*) filter (data_source = 'google_factcheck_api') as api_rows_added, "
    "count(*) filter (data_source = 'regional_archive') as archive_rows_added, "
    "count(*) filter (data_source is null) as unlabelled_rows, "
    "count(distinct review_url) + count(*) filter (review_url is null) as final_rows "
    f"from {{source}} where {KEPT} group by language)"
)
# Every eleventh row has lost its source.
UNLABELLED = "case when doc_id % 11 = 0 then null else data_source end"


def merge_accounting(spark, sf):
    return reports.merge_summary(merge.union_sources(by_source(spark, sf)))


def _with_query_lang(spark, sf):
    return views.claims(spark, sf).withColumn(
        "query_lang", F.expr("case when doc_id % 3 = 0 then 'en' else 'hi' end")
    )


def _balance_sql(by, source):
    return (
        f"select {by}, language, count(*) as rows, round(count(*) * 100.0 / "
        f"sum(count(*)) over (partition by {by}), 1) as share from {source} group by {by}, language"
    )


def landed_uniqueness(spark, sf):
    claims = views.claims(spark, sf).drop("doc_id", "review_title", "matched_query", "claim_date")
    sketches = stored(reports.landing_sketches(claims, ("data_source",)), "landing-sketches")
    both = reports.merged_uniqueness(sketches).unionByName(reports.uniqueness(claims.drop("data_source")))
    close = lambda c, name: (F.max(c) <= F.min(c) * 1.02).alias(name)
    return both.agg(F.max("rows").alias("rows"), close("unique_rows", "rows_close"), close("unique_urls", "urls_close"))


QUERIES = {
    "merge_summary": (merge_accounting, with_views(SUMMARY_SQL.format(source="claims_v"))),
    "merge_summary_unlabelled": (
        lambda s, d: reports.merge_summary(clean.keep_languages(
            views.claims(s, d).withColumn("data_source", F.expr(UNLABELLED))
        )),
        with_views(SUMMARY_SQL.format(source=f"(select * replace ({UNLABELLED} as data_source) from claims_v)")),
    ),
    "dataset_size_table": (
        lambda s, d: reports.size_table(views.claims(s, d)),
        with_views(
            "select data_source, count(*) filter (language = 'hi') as hi, count(*) filter "
            "(language = 'gu') as gu, count(*) filter (language = 'mr') as mr from claims_v group by 1"
        ),
    ),
    "extraction_mix": (
        lambda s, d: reports.extraction_mix(extract_claims(views.claim_pages(s, d), keep_empty=True)),
        with_views(
            "select extraction_method, count(*) as rows, round(count(*) * 100.0 / "
            "sum(count(*)) over (), 1) as share from (select extraction_method from expected_v "
            "where claim_text is not null union all select 'none' from documents where doc_id % 8 = 3 "
            "union all select 'none' from expected_v where claim_text is null) group by 1", E,
        ),
    ),
    "uniqueness_of_all_columns": (
        lambda s, d: reports.uniqueness(views.claims(s, d).drop("doc_id").unionByName(views.claims(s, d).drop("doc_id"))),
        with_views(
            "select cast(2 * (select count(*) from claims_v) as bigint) as rows, (select count(*) from "
            "(select distinct * exclude (doc_id) from claims_v)) as unique_rows, "
            "(select count(distinct review_url) from claims_v) as unique_urls"
        ),
    ),
    "qc_report": (
        lambda s, d: reports.qc_report(archive.archive_claims(views.claim_pages(s, d))),
        with_views(
            "select language, publisher_site, count(*) as rows, count(*) filter (claim_text = "
            f"'{BOILERPLATE_TEXT}') as flagged from extracted_v group by 1, 2", E, C,
        ),
    ),
    "qc_flagged_urls": (
        lambda s, d: reports.flagged_urls(archive.archive_claims(views.claim_pages(s, d))),
        with_views(
            f"select distinct review_url from extracted_v where claim_text = '{BOILERPLATE_TEXT}'", E, C,
        ),
    ),
    "uniqueness_count": (
        lambda s, d: reports.uniqueness(views.claims(s, d).drop("doc_id", "review_title", "matched_query", "claim_date")),
        with_views(
            "select cast((select count(*) from claims_v) as bigint) as rows, (select count(*) from "
            "(select distinct claim_text, claimant, publisher_name, publisher_site, review_url, "
            "review_date, rating, language, data_source from claims_v)) as unique_rows, "
            "(select count(distinct review_url) from claims_v) as unique_urls"
        ),
    ),
    # Merged from one sketch a landing, and held against the exact count of all of them.
    "uniqueness_by_landing": (
        landed_uniqueness,
        with_views("select count(*) as rows, true as rows_close, true as urls_close from claims_v"),
    ),
    "source_yield_ratio": (
        lambda s, d: reports.yield_ratio(views.claims(s, d)),
        with_views(
            "select language, archive_rows, api_rows, round(archive_rows / nullif(api_rows, 0), 2) "
            "as ratio from (select language, count(*) filter (data_source = 'regional_archive') as "
            "archive_rows, count(*) filter (data_source = 'google_factcheck_api') as api_rows "
            "from claims_v group by 1)"
        ),
    ),
    "language_balance": (
        lambda s, d: reports.language_balance(_with_query_lang(s, d)),
        with_views(_balance_sql(
            "query_lang",
            "(select *, case when doc_id % 3 = 0 then 'en' else 'hi' end as query_lang from claims_v)",
        )),
    ),
    "language_balance_by_query": (
        lambda s, d: reports.language_balance(views.claims(s, d), "matched_query"),
        with_views(_balance_sql("matched_query", "claims_v")),
    ),
    "share_of_total": (
        lambda s, d: reports.with_share(
            clean.keep_languages(views.claims(s, d)).groupBy("language", "data_source").agg(
                F.count(F.lit(1)).alias("rows")
            ),
            "rows",
        ),
        with_views(
            "select language, data_source, count(*) as rows, round(count(*) * 100.0 / sum(count(*)) "
            f"over (), 1) as share from claims_v where {KEPT} group by 1, 2"
        ),
    ),
}

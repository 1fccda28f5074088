"""Queries over claim rows: projection, cleaning, derivation, merge, joins."""

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions.claims import derive_claims
from claimloom.operators import clean, dedupe
from claimloom.plans import merge, views
from claimloom.plans.views import with_views
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small
from claimloom.sources import scans

RAW = ", ".join(schemas.RAW_COLUMNS)
KEPT = "language in ('hi', 'gu', 'mr')"
PRIORITY = (
    "case data_source when 'xfact_2021' then 1 when 'google_factcheck_api' then 2 "
    "when 'regional_archive' then 3 else 4 end"
)
TIES = (
    "review_date asc nulls last, claim_date asc nulls first, claim_text asc nulls first, "
    "claimant asc nulls first, matched_query asc nulls first, publisher_name asc nulls first, "
    "publisher_site asc nulls first, rating asc nulls first, review_title asc nulls first"
)
KEPT_SQL = (
    f"select {RAW}, data_source from (select *, row_number() over (partition by language, "
    f"review_url order by {PRIORITY}, {TIES}) as rn from claims_v where {KEPT}) "
    "where rn = 1 or review_url is null"
)

HOST_SQL = (
    r"nullif(regexp_extract(lower(trim({c})), "
    r"'^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?(?:www\.)?([^/:?#]+)', 1), '')"
)
DATE_SQL = (
    "coalesce(try_cast(try_strptime(claim_date, '%Y-%m-%dT%H:%M:%SZ') as date), "
    "try_cast(try_strptime(claim_date, '%d/%m/%Y') as date), "
    "try_cast(try_strptime(claim_date, '%B %d, %Y') as date))"
)
_LETTERS = "length(regexp_replace(claim_text, '[^\\p{{{s}}}]', '', 'g'))"
_DEVA, _GUJR, _LATN = (_LETTERS.format(s=s) for s in ("Devanagari", "Gujarati", "Latin"))

DERIVED_SQL = {
    "claim_date_parsed": DATE_SQL,
    "claim_year": f"cast(year({DATE_SQL}) as integer)",
    "claim_month": f"cast(month({DATE_SQL}) as integer)",
    "publisher_domain": (
        f"coalesce({HOST_SQL.format(c='publisher_site')}, {HOST_SQL.format(c='review_url')})"
    ),
    "rating_clean": (
        "nullif(trim(regexp_replace(lower(trim(regexp_replace(rating, "
        r"'[ \t\n\r\f]+', ' ', 'g'))), '[.!?,;:। ]+$', '')), '')"
    ),
    "language_name": (
        "case language when 'hi' then 'Hindi' when 'gu' then 'Gujarati' "
        "when 'mr' then 'Marathi' end"
    ),
    "claim_char_len": "cast(length(claim_text) as integer)",
    "claim_word_len": (
        r"cast(len(regexp_extract_all(claim_text, '[^ \t\n\r\f]+')) as integer)"
    ),
    "detected_script": (
        f"case when greatest({_DEVA}, {_GUJR}, {_LATN}) = 0 then 'Other' "
        f"when {_DEVA} >= {_GUJR} and {_DEVA} >= {_LATN} then 'Devanagari' "
        f"when {_GUJR} >= {_LATN} then 'Gujarati' else 'Latin' end"
    ),
    "has_claimant": "coalesce(trim(claimant) <> '', false)",
    "data_source": "data_source",
}
MERGED_SQL = (
    f"select {RAW}, " + ", ".join(f"{e} as {n}" for n, e in DERIVED_SQL.items())
    + " from kept_v"
)


def by_source(spark, sf):
    """The claims as three separate sources."""
    claims = views.claims(spark, sf)
    return [
        claims.filter(F.col("data_source") == s).drop("doc_id") for s in schemas.SOURCE_PRIORITY
    ]


def merged(spark, sf):
    return merge.merge_claims(by_source(spark, sf))


def labelled(spark, sf):
    """Ids of the labelled documents, as the rows collected before."""
    return views.table(spark, sf, "labels").select("doc_id").distinct()


def _external(spark, sf):
    mapping = {
        "claim_text": "text", "publisher_name": "source", "language": "lang", "review_url": "doc_id",
    }
    return scans.map_source(views.documents(spark, sf), mapping, schemas.EXTERNAL)


def _response(spark, sf):
    return _responses(spark, sf).drop("doc_id")


def _responses(spark, sf):
    """One search response per document: a claim with two reviews, one without
    reviews; one response in seven has no claims."""
    c = views.claims(spark, sf)
    review = F.struct(
        F.struct(F.col("publisher_name").alias("name"), F.col("publisher_site").alias("site")).alias("publisher"),
        F.col("review_url").alias("url"), F.col("review_title").alias("title"),
        F.col("review_date").alias("reviewDate"), F.col("rating").alias("textualRating"),
        F.col("language").alias("languageCode"),
    )
    second = F.struct(
        F.struct(F.col("publisher_name").alias("name"), F.lit(None).cast("string").alias("site")).alias("publisher"),
        F.concat(F.lit("https://s.example.org/"), "doc_id").alias("url"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("reviewDate"),
        F.lit("Misleading").alias("textualRating"), F.lit("hi").alias("languageCode"),
    )
    full = F.struct(
        F.col("claim_text").alias("text"), "claimant", F.col("claim_date").alias("claimDate"),
        F.array(review, second).alias("claimReview"),
    )
    bare = F.struct(
        F.lit("bare claim").alias("text"), F.lit(None).cast("string").alias("claimant"),
        F.lit(None).cast("string").alias("claimDate"),
        F.array().cast(full_type(review)).alias("claimReview"),
    )
    body = F.to_json(F.struct(F.array(full, bare).alias("claims")))
    response = F.when(F.col("doc_id") % 7 == 0, F.lit("{}")).otherwise(body)
    return c.select("doc_id", "matched_query", response.alias("response"))


def full_type(_):
    return (
        "array<struct<publisher:struct<name:string,site:string>,url:string,title:string,"
        "reviewDate:string,textualRating:string,languageCode:string>>"
    )


def _landing(spark, sf):
    """The responses, some cut off, some error envelopes, some not objects."""
    broken = (
        "case doc_id % 11 when 0 then substr(response, 1, length(response) - 1) "
        "when 1 then '{\"error\":{\"code\":429}}' when 2 then '[1]' when 3 then '{\"claims\":7}' else response end"
    )
    return _responses(spark, sf).selectExpr("matched_query", f"{broken} as response")


def _reject_counts(spark, sf):
    """Landed responses, and those that are rejected, by reason."""
    landed = _landing(spark, sf)
    rejects = scans.response_rejects(landed).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    return landed.agg(F.lit("landed").alias("reason"), F.count(F.lit(1)).alias("rows")).unionByName(rejects)


RESPONSES_SQL = (
    f"select {RAW} from claims_v where doc_id % 7 <> 0 union all "
    "select claim_text, claimant, claim_date, publisher_name, null, null, "
    "concat('https://s.example.org/', cast(doc_id as varchar)), null, 'Misleading', 'hi', "
    "matched_query from claims_v where doc_id % 7 <> 0 union all "
    "select 'bare claim', null, null, null, null, null, null, null, null, null, matched_query "
    "from claims_v where doc_id % 7 <> 0"
)


def _rating_labels(spark, sf):
    """Optional rating map, here read off the ratings that occur."""
    ratings = derive_claims(views.claims(spark, sf)).select("rating_clean").distinct()
    return ratings.filter("rating_clean is not null").select(
        "rating_clean",
        F.when(F.contains("rating_clean", F.lit("partly")), "MIXED").otherwise("FALSE").alias("label"),
    )


def _mapped_ratings(spark, sf):
    rows = derive_claims(views.claims(spark, sf)).select("doc_id", "rating_clean")
    labels = broadcast_if_small(stored(_rating_labels(spark, sf), "rating-labels"))
    return rows.join(labels, "rating_clean", "left").select("doc_id", "rating_clean", "label")


def _snapshot(spark, sf):
    """An older filtered copy without the query; some ratings were edited since."""
    c = views.claims(spark, sf).join(labelled(spark, sf), "doc_id", "left_semi")
    edited = F.when(F.col("doc_id") % 7 == 0, F.lit("edited")).otherwise(F.col("rating"))
    return c.withColumn("rating", edited).drop("matched_query", "doc_id")


SNAPSHOT_COLUMNS = RAW.replace(", matched_query", "") + ", data_source"

QUERIES = {
    "api_response_flatten": (
        lambda s, d: scans.flatten_responses(_response(s, d)), with_views(RESPONSES_SQL),
    ),
    "response_rejects": (
        _reject_counts,
        "select 'landed' as reason, count(*) as rows from documents union all select 'unreadable', count(*) from documents "
        "where doc_id % 11 in (0, 2, 3) union all select 'error', count(*) from documents where doc_id % 11 = 1",
    ),
    "external_dataset_map": (
        _external,
        "select text as claim_text, cast(null as varchar) as claimant, cast(null as varchar) as "
        "claim_date, source as publisher_name, cast(null as varchar) as publisher_site, "
        "cast(null as varchar) as review_title, cast(doc_id as varchar) as review_url, "
        "cast(null as varchar) as review_date, cast(null as varchar) as rating, lang as language, "
        "cast(null as varchar) as matched_query, 'xfact_2021' as data_source from documents",
    ),
    "query_rename": (
        lambda s, d: clean.rename_query(views.claims(s, d)),
        with_views("select * exclude (matched_query), matched_query as query from claims_v"),
    ),
    "language_filter": (
        lambda s, d: clean.keep_languages(views.claims(s, d)),
        with_views(f"select * from claims_v where {KEPT}"),
    ),
    "drop_incomplete_rows": (
        lambda s, d: clean.drop_missing(views.claims(s, d)),
        with_views(
            "select * from claims_v where claimant is not null and claim_date is not null "
            "and claim_date <> '' and review_url is not null and rating is not null "
            "and language is not null and claim_text <> ''"
        ),
    ),
    "schema_alignment": (
        lambda s, d: clean.align(
            views.claims(s, d).drop("claimant").withColumn("extra", F.lit(1)), schemas.RAW
        ),
        with_views(f"select {RAW} from (select * replace (cast(null as varchar) as claimant) from claims_v)"),
    ),
    "derived_columns": (
        lambda s, d: derive_claims(views.claims(s, d)),
        with_views(
            "select * exclude (data_source), "
            + ", ".join(f"{e} as {n}" for n, e in DERIVED_SQL.items()) + " from claims_v"
        ),
    ),
    "rating_label_lookup": (
        _mapped_ratings,
        with_views(
            f"select doc_id, {DERIVED_SQL['rating_clean']} as rating_clean, "
            f"case when {DERIVED_SQL['rating_clean']} like '%partly%' then 'MIXED' "
            f"when {DERIVED_SQL['rating_clean']} is not null then 'FALSE' end as label from claims_v"
        ),
    ),
    "url_dedup": (
        lambda s, d: dedupe.dedupe_by_url(
            clean.keep_languages(views.claims(s, d)).drop("doc_id")
        ),
        with_views(KEPT_SQL),
    ),
    "source_union_merge": (merged, with_views(MERGED_SQL, ("claims_kept", KEPT_SQL), ("kept_v", "select * from claims_kept"))),
    "resume_skip": (
        lambda s, d: dedupe.skip_collected(
            views.claims(s, d),
            views.claims(s, d).join(labelled(s, d), "doc_id", "left_semi").select("review_url"),
        ),
        with_views(
            "select * from claims_v where review_url is null or review_url not in (select "
            "review_url from claims_v where doc_id in (select doc_id from labels) "
            "and review_url is not null)"
        ),
    ),
    "source_overlap": (
        lambda s, d: dedupe.source_overlap(views.claims(s, d)),
        with_views(
            "select language, review_url, string_agg(distinct data_source, ',' order by data_source) "
            "as sources, count(distinct data_source) as source_count, count(*) as rows from claims_v "
            "where review_url is not null group by all having count(distinct data_source) > 1"
        ),
    ),
    "source_overlap_rows": (
        lambda s, d: dedupe.overlap_rows(views.claims(s, d)),
        with_views(
            "select * from claims_v where review_url in (select review_url from claims_v "
            "group by 1 having count(distinct data_source) > 1)"
        ),
    ),
    "snapshot_subset_check": (
        lambda s, d: dedupe.missing_from(views.claims(s, d), _snapshot(s, d)),
        with_views(
            f"select {SNAPSHOT_COLUMNS} from (select * replace (case when doc_id % 7 = 0 then "
            "'edited' else rating end as rating) from claims_v where doc_id in (select doc_id "
            f"from labels)) except all select {SNAPSHOT_COLUMNS} from claims_v"
        ),
    ),
    "top_k_per_group": (
        lambda s, d: dedupe.top_k(
            views.claims(s, d).select("language", "publisher_name", "doc_id", F.length("claim_text").alias("chars")),
            ["language", "publisher_name"], [F.col("chars").desc(), F.col("doc_id")], 5,
        ),
        with_views(
            "select language, publisher_name, doc_id, cast(length(claim_text) as integer) as chars, "
            "cast(row_number() over w as integer) as rank from claims_v window w as (partition by "
            "language, publisher_name order by length(claim_text) desc, doc_id) qualify rank <= 5"
        ),
    ),
}


def _derived(name):
    return lambda s, d: derive_claims(views.claims(s, d)).select("doc_id", name)


for _name, _sql in DERIVED_SQL.items():
    QUERIES[f"derive_{_name}"] = (
        _derived(_name), with_views(f"select doc_id, {_sql} as {_name} from claims_v"),
    )

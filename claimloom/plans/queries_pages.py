"""Queries over article pages."""

import os

from pyspark.sql import functions as F

from claimloom.operators import clean, extract, frontier
from claimloom.plans import archive, views
from claimloom.plans.queries_claims import HOST_SQL, labelled
from claimloom.plans.views import BOILERPLATE_TEXT, with_views
from claimloom.sources import scans

FLAT = r"nullif(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), '')"
URL = "concat('https://', source, '.example.org/a/', cast(doc_id as varchar))"
HOST = "concat(source, '.example.org')"
NULL = "cast(null as varchar)"

# What each page was made from: method, claim, rating, language, title, ...
EXPECTED = (
    f"select doc_id, source, {URL} as url, unnest(case doc_id % 8 "
    "when 3 then [] "
    f"when 7 then ['{BOILERPLATE_TEXT}'] "
    f"when 5 then [{FLAT}, 'second claim'] "
    f"else [{FLAT}] end) as claim_text, "
    "case when doc_id % 8 in (0, 5, 6) then 'json_ld' else 'html_fallback' end as extraction_method "
    "from documents"
)
EXPECTED_CLAIMS = (
    f"select claim_text, {NULL} as claimant, {NULL} as claim_date, "
    "case when doc_id % 8 = 6 then source end as publisher_name, "
    f"{HOST} as publisher_site, "
    "case when doc_id % 8 = 2 then 'Fact check' end as review_title, "
    "case when doc_id % 8 = 6 then concat('https://f.example.org/', cast(doc_id as varchar)) else url end as review_url, "
    f"{NULL} as review_date, "
    "case doc_id % 8 when 0 then 'False' when 1 then 'False' when 2 then 'Partly False' end as rating, "
    "case doc_id % 8 when 0 then 'hi' when 1 then 'gu' when 2 then 'mr' when 4 then 'mr' "
    "when 5 then case when claim_text <> 'second claim' then 'gu' end when 7 then 'gu' end as language, "
    f"{NULL} as matched_query, extraction_method from expected_v where claim_text is not null"
)
JSON_SQL = (
    f"select url, claim_text, {NULL} as claimant, {NULL} as claim_date, "
    "case when doc_id % 8 = 6 then source end as publisher_name, "
    f"{NULL} as publisher_site, {NULL} as review_title, "
    "case when doc_id % 8 = 6 then concat('https://f.example.org/', cast(doc_id as varchar)) end as review_url, "
    f"{NULL} as review_date, case when doc_id % 8 = 0 then 'False' end as rating, "
    "case when doc_id % 8 = 5 and claim_text <> 'second claim' then 'gu' end as language "
    "from expected_v where extraction_method = 'json_ld' and claim_text is not null"
)
E = ("expected_v", EXPECTED)
C = ("extracted_v", EXPECTED_CLAIMS)

LANDMARK_SQL = {
    "json_ld": r"(?i)<script[^>]*application/ld\+json",
    "claim": r"\bClaim\b",
    "fact": r"\bFact\b",
    "result": r"\b(?:RESULT|Result)\b",
    "verification": r"\bVerification\b",
}
COUNTS_SQL = ", ".join(
    f"cast(len(regexp_extract_all(html, '{p}')) as bigint) as {n}" for n, p in LANDMARK_SQL.items()
)
ALL_PAGES_SQL = "select url, html from pages union all select url, html from claim_pages_v"
PROFILE_SQL = (
    f"select host, count(*) as pages, "
    + ", ".join(f"cast(sum({n}) as bigint) as {n}" for n in LANDMARK_SQL) + ", "
    + ", ".join(f"count(*) filter ({n} > 0) as pages_with_{n}" for n in LANDMARK_SQL)
    + f" from (select {HOST_SQL.format(c='url')} as host, {COUNTS_SQL} from all_pages_v) group by host"
)

LISTING = {
    "page_id": "doc_id",
    "url": "concat('https://', source, '.example.org/list/', cast(doc_id as STRING))",
    "html": (
        "concat('<html><a href=\"/a/', cast(doc_id as STRING), '\">x</a> <a class=\"n\" href=\"https://', "
        "source, '.example.org/a/', cast(doc_id % 97 as STRING), '\">y</a><a href=\"//', source, "
        "'.example.org/b/', cast(doc_id as STRING), '\">z</a><a href=\"#top\">t</a><p>', "
        + views.ESCAPED + ", '</p></html>')"
    ),
}
ARTICLE = r"/[ab]/[0-9]+$"


def listings(spark, sf):
    return views._select(views.documents(spark, sf), LISTING)


def landed(spark, sf):
    docs = views.documents(spark, sf).join(labelled(spark, sf), "doc_id", "left_semi")
    return docs.selectExpr("concat('https://', source, '.example.org/a/', doc_id) as url")


def rules(spark, sf):
    """Robots rules of every host: nested prefixes, and a tie of allow and disallow."""
    hosts = views.documents(spark, sf).select(
        F.concat("source", F.lit(".example.org")).alias("host")
    ).distinct()
    rule = [("/a/1", False), ("/a/12", True), ("/a/2", False), ("/a/2", True), ("/b/", False), ("/b/3", True)]
    return hosts.select(
        "host",
        F.inline(F.array(*(
            F.struct(F.lit(p).alias("prefix"), F.lit(a).alias("allow")) for p, a in rule
        ))),
    )


FRONTIER_SQL = (
    "select distinct url from (select concat('https://', source, '.example.org/a/', doc_id) as url "
    "from documents union all select concat('https://', source, '.example.org/a/', doc_id % 97) "
    "from documents union all select concat('https://', source, '.example.org/b/', doc_id) from documents) "
    "where url not in (select concat('https://', source, '.example.org/a/', doc_id) from documents "
    "where doc_id in (select doc_id from labels))"
)
ALLOWED_SQL = (
    "select url from (" + FRONTIER_SQL + ") where case when url like '%.example.org/a/12%' then true "
    "when url like '%.example.org/a/1%' then false when url like '%.example.org/b/3%' then true "
    "when url like '%.example.org/b/%' then false else true end"
)

# Cut at the tag, at the attribute and at the quote that opens the value: no pattern in common with the operator.
PAGE_LINKS_SQL = (
    "select page_url, trim(replace(string_split(case left(v, 1) when '\"' then string_split(v, '\"')[2] "
    "when '''' then string_split(v, '''')[2] else string_split(v, ' ')[1] end, '#')[1], '&amp;', '&')) as href "
    "from (select page_url, string_split(string_split(tag, '>')[1], ' href=')[2] as v from "
    "(select url as page_url, unnest(string_split(html, '<a')[2:]) as tag from pages) where starts_with(tag, ' ')) where v is not null"
)
PAGE_FRONTIER_SQL = (
    "select distinct link as url from (select case when href like 'http%' then href else "
    "concat(regexp_extract(page_url, '^([a-z]+://[^/?#]+)', 1), href) end as link from links_v "
    "where href like '/%' or href like 'http%') where link not in (select url from pages)"
)

QUERIES = {
    "page_scan": (
        lambda s, d: scans.read_pages(s, os.path.join(d, "pages.parquet")),
        "select page_id, url, html from pages",
    ),
    "claimreview_jsonld": (
        lambda s, d: extract.extract_jsonld(views.claim_pages(s, d)), with_views(JSON_SQL, E),
    ),
    "template_a": (
        lambda s, d: extract.extract_template_a(views.claim_pages(s, d)),
        with_views(
            "select url, claim_text, case when doc_id % 8 = 1 then 'False' end as rating "
            "from expected_v where doc_id % 8 in (1, 7) and claim_text is not null", E,
        ),
    ),
    "template_b": (
        lambda s, d: extract.extract_template_b(views.claim_pages(s, d)),
        with_views(
            "select url, case when doc_id % 8 = 6 then 'unused' else claim_text end as claim_text, "
            "case when doc_id % 8 = 2 then 'Partly False' end as rating "
            "from expected_v where doc_id % 8 in (2, 4, 6) and claim_text is not null", E,
        ),
    ),
    "extraction_dispatch": (
        lambda s, d: extract.extract_claims(views.claim_pages(s, d)),
        with_views(EXPECTED_CLAIMS, E),
    ),
    "extraction_null_branch": (
        lambda s, d: extract.extract_claims(
            views.table(s, d, "pages"), keep_empty=True
        ).groupBy("extraction_method").agg(F.count(F.lit(1)).alias("rows")),
        f"select {NULL} as extraction_method, count(*) as rows from pages",
    ),
    "landmark_profile": (
        lambda s, d: extract.profile_landmarks(
            views.table(s, d, "pages").select("url", "html").unionByName(
                views.claim_pages(s, d).select("url", "html")
            )
        ),
        with_views(PROFILE_SQL, ("all_pages_v", ALL_PAGES_SQL)),
    ),
    "landmark_counts": (
        lambda s, d: extract.landmark_counts(views.claim_pages(s, d)),
        with_views(f"select url, {HOST_SQL.format(c='url')} as host, {COUNTS_SQL} from claim_pages_v"),
    ),
    "article_frontier": (
        lambda s, d: frontier.article_frontier(listings(s, d), ARTICLE, landed(s, d)), FRONTIER_SQL,
    ),
    "page_link_frontier": (
        lambda s, d: frontier.article_frontier(views.table(s, d, "pages"), "^https?://"),
        with_views(PAGE_FRONTIER_SQL, ("links_v", PAGE_LINKS_SQL)),
    ),
    "crawl_rule_filter": (
        lambda s, d: frontier.allowed_urls(
            frontier.article_frontier(listings(s, d), ARTICLE, landed(s, d)), rules(s, d)
        ),
        ALLOWED_SQL,
    ),
    "boilerplate_flag": (
        lambda s, d: archive.archive_claims(views.claim_pages(s, d)),
        with_views(
            f"select *, claim_text = '{BOILERPLATE_TEXT}' as is_boilerplate from extracted_v", E, C,
        ),
    ),
    "boilerplate_drop": (
        lambda s, d: clean.drop_boilerplate(extract.extract_claims(views.claim_pages(s, d))),
        with_views(f"select * from extracted_v where claim_text <> '{BOILERPLATE_TEXT}'", E, C),
    ),
}

"""Inputs of the registered queries, derived from the whole given tables.

The given documents hold no Indic text, no claims and no claim markup. Each view
derives them from every row and the whole text, with one expression list that both
Spark and the SQL check can read (`STRING` is spelled `VARCHAR` for the latter).
"""

import os

from pyspark.sql import functions as F

from claimloom.sizing import spread

# One letter or vowel sign for each of a..z.
LATIN = "abcdefghijklmnopqrstuvwxyz"
DEVANAGARI = "ािकखेगघचीछजलमनोपतरसटुवयहडझ"
GUJARATI = "ાિકખેગઘચીછજલમનોપતરસટુવયહડઝ"

BOILERPLATE_TEXT = "This site is an independent fact-checking initiative of its publisher"

SPACED = "trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' '{g}))"

CORPUS = {
    "doc_id": "doc_id",
    "lang": "case lang when 'en' then 'hi' when 'fr' then 'gu' when 'de' then 'mr' else lang end",
    "text": (
        f"case when lang in ('en', 'de') then translate(text, '{LATIN}', '{DEVANAGARI}') "
        f"when lang = 'fr' then translate(text, '{LATIN}', '{GUJARATI}') else text end"
    ),
}

CLAIM_KEYS = {
    "uid": (
        "case when doc_id % 4 = 3 then doc_id - 3 when doc_id % 8 = 5 then doc_id - 4 "
        "when doc_id % 16 = 10 then doc_id - 2 else doc_id end"
    ),
    "blk": "cast(floor(doc_id / 8) as bigint) % 10",
}

CLAIM_LANGUAGE = (
    "case when blk < 5 then 'hi' when blk = 5 then 'gu' when blk < 8 then 'mr' "
    "when blk = 8 then 'en' else null end"
)

CLAIMS = {
    "claim_text": (
        f"case when blk = 5 then translate(text, '{LATIN}', '{GUJARATI}') "
        f"when blk < 8 then translate(text, '{LATIN}', '{DEVANAGARI}') else text end"
    ),
    "claimant": (
        "case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then ' ' "
        "else concat('claimant ', cast(doc_id % 37 as STRING)) end"
    ),
    "claim_date": (
        "case doc_id % 6 when 0 then concat('20', cast(15 + doc_id % 9 as STRING), '-0', "
        "cast(1 + doc_id % 9 as STRING), '-11T10:00:00Z') "
        "when 1 then concat('0', cast(1 + doc_id % 9 as STRING), '/0', "
        "cast(1 + doc_id % 8 as STRING), '/2021') "
        "when 2 then concat('March ', cast(1 + doc_id % 28 as STRING), ', 2022') "
        "when 3 then 'not a date' when 4 then '' else null end"
    ),
    "publisher_name": "source",
    "publisher_site": "concat('https://www.', source, '.example.org/')",
    "review_title": "concat('Fact check ', cast(doc_id as STRING))",
    "review_url": (
        "case when doc_id % 41 = 0 then null "
        "else concat('https://f.example.org/', cast(uid as STRING)) end"
    ),
    "review_date": "concat('2023-0', cast(1 + doc_id % 9 as STRING), '-05')",
    "rating": (
        "case doc_id % 4 when 0 then ' False ' when 1 then 'FALSE.' "
        "when 2 then 'Partly  False' else null end"
    ),
    "language": CLAIM_LANGUAGE,
    "matched_query": "concat('q', cast(doc_id % 13 as STRING))",
    "data_source": (
        "case when doc_id % 4 = 0 then 'xfact_2021' when doc_id % 4 = 2 "
        "then 'regional_archive' else 'google_factcheck_api' end"
    ),
    "doc_id": "doc_id",
}

ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
JSON_TEXT = "to_json(struct(text as claimReviewed))"
JSON_TEXT_SQL = "CAST(json_object('claimReviewed', text) AS VARCHAR)"

# Every extraction branch, by doc_id. `{review}` is a ClaimReview's first property.
CLAIM_PAGES = {
    "page_id": "doc_id",
    "url": "concat('https://', source, '.example.org/a/', cast(doc_id as STRING))",
    "html": (
        "case doc_id % 8 "
        "when 0 then concat('<html lang=\"hi\"><script type=\"application/ld+json\">', case when doc_id % 16 = 8 then '[' else '' end, "
        "'{{\"@graph\":[{{\"@type\":\"ClaimReview\",\"reviewRating\":{{\"alternateName\":\"False\"}},', "
        "substr({review}, 2), ',{{\"@type\":\"WebPage\"}}]}}', case when doc_id % 16 = 8 then ']' else '' end, '</script></html>') "
        "when 1 then concat('<html lang=\"gu\"><div><b>Claim</b><p>', {escaped}, "
        "'</p><b>Fact</b><p>f</p></div><p>RESULT</p><p>False</p></html>') "
        "when 2 then concat('<html lang=\"mr\"><h1>Fact check</h1><p><strong>Claim –</strong> ', {escaped}, "
        "'<br><strong>Fact –</strong> f</p><h3>Result:Partly False</h3></html>') "
        "when 3 then concat('<html><p>', {escaped}, '</p><p>{boilerplate}</p></html>') "
        "when 4 then concat('<html lang=\"mr\"><script type=\"application/ld+json\">not json</script>"
        "<p><strong>Claim &#8211;</strong> ', {escaped}, '</p></html>') "
        "when 5 then concat('<html><script type=''application/ld+json''>[{{\"@type\":\"ClaimReview\","
        "\"inLanguage\":\"gu\",', substr({review}, 2), ',{{\"@type\":[\"Review\",\"ClaimReview\"],"
        "\"claimReviewed\":\"second claim\"}}]</script></html>') "
        "when 6 then concat('<html><script type=\"application/ld+json\">', case doc_id % 24 when 6 then '{{\"@graph\":' "
        "when 14 then '{{\"@type\":\"Article\",\"review\":' else '' end, '{{\"@type\":', case when doc_id % 16 = 6 then "
        "'[\"ClaimReview\"]' else '\"https://schema.org/ClaimReview\"' end, ',\"url\":\"https://f.example.org/', cast(doc_id as STRING), '\",\"author\":{{\"name\":\"', source, '\"}},', "
        "substr({review}, 2), case when doc_id % 24 in (6, 14) then '}}' else '' end, "
        "'</script><p><strong>Claim –</strong> unused</p></html>') "
        "else concat('<html lang=\"gu\"><div><b>Claim</b><p>{boilerplate}</p><b>Fact</b><p>', "
        "{escaped}, '</p></div></html>') end"
    ),
}


def _fill(expr, review):
    return expr.format(review=review, escaped=ESCAPED, boilerplate=BOILERPLATE_TEXT)


def table(spark, sf_dir, name):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _select(df, exprs):
    return df.selectExpr(*(f"{e} as {name}" for name, e in exprs.items()))


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def corpus(spark, sf_dir):
    return _select(documents(spark, sf_dir), CORPUS)


def corpus_as_read(spark, sf_dir):
    """`corpus` in the partitions it is read in, for operators that deal the texts out themselves."""
    return _select(table(spark, sf_dir, "documents"), CORPUS)


def claims(spark, sf_dir):
    keyed = documents(spark, sf_dir).selectExpr(
        "*", *(f"{e} as {name}" for name, e in CLAIM_KEYS.items())
    )
    return _select(keyed, CLAIMS)


def claim_pages(spark, sf_dir):
    exprs = {n: _fill(e, JSON_TEXT) if n == "html" else e for n, e in CLAIM_PAGES.items()}
    return _select(documents(spark, sf_dir), exprs)


def wide_claims(spark, sf_dir):
    """Twelve-column claims with `doc_id`; one in 16 has an empty language."""
    query_lang = F.expr("case when doc_id % 3 = 0 then 'en' else 'hi' end")
    language = F.expr("case when doc_id % 16 = 0 then '' else coalesce(language, 'und') end")
    return claims(spark, sf_dir).select(
        F.col("matched_query").alias("query"),
        query_lang.alias("query_lang"),
        *("claim_text claimant claim_date publisher_name publisher_site review_title "
          "review_url review_date").split(),
        F.coalesce("rating", F.lit("unrated")).alias("rating"),
        language.alias("language"),
        "doc_id",
    )


def _sql(exprs, source):
    body = ", ".join(f"{e} as {name}" for name, e in exprs.items())
    return f"select {body} from {source}".replace("STRING", "VARCHAR")


def sql_views():
    """Name → SQL of the views, in the order in which they depend on each other."""
    pages = {n: _fill(e, JSON_TEXT_SQL) if n == "html" else e for n, e in CLAIM_PAGES.items()}
    keys = ", ".join(f"{e} as {n}" for n, e in CLAIM_KEYS.items())
    return {
        "corpus_v": _sql(CORPUS, "documents"),
        "keyed_v": f"select *, {keys} from documents",
        "claims_v": _sql(CLAIMS, "keyed_v"),
        "claim_pages_v": _sql(pages, "documents"),
        "wide_v": (
            "select matched_query as query, case when doc_id % 3 = 0 then 'en' else 'hi' end "
            "as query_lang, claim_text, claimant, claim_date, publisher_name, publisher_site, "
            "review_title, review_url, review_date, coalesce(rating, 'unrated') as rating, "
            "case when doc_id % 16 = 0 then '' else coalesce(language, 'und') end as language, "
            "doc_id from claims_v"
        ),
        # An empty field of a CSV file reads as null.
        "wide_csv_v": (
            "select * replace (nullif(claim_date, '') as claim_date, nullif(language, '') as "
            "language) from wide_v"
        ),
        # Rows with doc_id % 4 <> 0 as read back after being written without query_lang.
        "shifted_v": (
            "select doc_id, query, s, case when s then claim_text else query_lang end as query_lang, "
            "case when s then claimant else claim_text end as claim_text, "
            "case when s then claim_date else claimant end as claimant, "
            "case when s then publisher_name else claim_date end as claim_date, "
            "case when s then publisher_site else publisher_name end as publisher_name, "
            "case when s then review_title else publisher_site end as publisher_site, "
            "case when s then review_url else review_title end as review_title, "
            "case when s then review_date else review_url end as review_url, "
            "case when s then rating else review_date end as review_date, "
            "case when s then language else rating end as rating, "
            "case when s then null else language end as language "
            "from (select *, doc_id % 4 <> 0 as s from wide_csv_v)"
        ),
    }


NEEDS = {
    "claims_v": ["keyed_v"],
    "wide_v": ["keyed_v", "claims_v"],
    "wide_csv_v": ["keyed_v", "claims_v", "wide_v"],
    "shifted_v": ["keyed_v", "claims_v", "wide_v", "wide_csv_v"],
}


def with_views(body, *extra):
    """SQL text of `body` with the views it names and `extra` (name, sql) CTEs."""
    views = sql_views()
    whole = body + " ".join(sql for _, sql in extra)
    wanted = set()
    for name in views:
        if name in whole:
            wanted |= {name, *NEEDS.get(name, [])}
    ctes = [(n, s) for n, s in views.items() if n in wanted] + list(extra)
    if not ctes:
        return body
    return "with " + ", ".join(f"{n} as ({s})" for n, s in ctes) + " " + body

"""Claims from landed article pages. One pass over the pages, no join, no shuffle.

Arrays that are costly to build are exploded with the `_outer` generators and
filtered afterwards: for the plain ones Catalyst infers a `size(..) > 0` filter,
pushes it to the scan and so builds every array twice.
"""

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions import html as hx
from claimloom.functions import jsonld
from claimloom.functions.claims import publisher_domain

JSON_LD = "json_ld"
HTML_FALLBACK = "html_fallback"

_HAS_CLAIM = r"(?i)claim"


def extract_jsonld(pages):
    """One row per ClaimReview object of each page."""
    found = pages.select("url", F.explode_outer(jsonld.claim_reviews("html")).alias("c"))
    return found.select("url", "c.*").filter(F.col("claim_text").isNotNull())


def _template(pages, claim):
    """`claim` sees the page as `boxes`, which is built once per page."""
    read = pages.filter(F.col("html").rlike(_HAS_CLAIM)).withColumn("boxes", hx.page_boxes("html"))
    found = F.struct(claim.alias("claim_text"), hx.result_of("boxes").alias("rating"))
    # A filter right on the claim would be pushed down and evaluate it twice.
    rows = read.select("url", F.inline_outer(F.array(found)))
    return rows.filter(F.col("claim_text").isNotNull())


def extract_template_a(pages):
    """Claim and result of pages with a "Claim / Fact" box."""
    return _template(pages, hx.template_a_claim("boxes"))


def extract_template_b(pages):
    """Claim and result of pages with inline bold labels."""
    return _template(pages, hx.template_b_claim("boxes"))


def extract_claims(pages, language=None, keep_empty=False):
    """JSON-LD first, else the HTML templates; records `extraction_method`.

    `language` (a code or column) is that of the edition being read; without it
    the page's own `lang` attribute is used. A page without a claim has no row,
    or, with `keep_empty`, one row whose method is null.
    """
    edition = (
        F.lit(language) if isinstance(language, str)
        else language if language is not None
        else hx.page_language("html")
    )
    read = pages.select(
        "url", "html", edition.alias("edition"), jsonld.claim_reviews("html").alias("found")
    )
    structured = F.coalesce(F.size("found") > 0, F.lit(False))
    # Null where the JSON-LD branch holds or no template can match, so that the
    # HTML work is done only for the pages that need it, and once.
    read = read.withColumn(
        "boxes",
        F.when(~structured & F.col("html").rlike(_HAS_CLAIM), hx.page_boxes("html")),
    )
    needs_html = F.col("boxes").isNotNull()
    null = F.lit(None).cast("string")
    fallback = F.struct(
        F.coalesce(hx.template_a_claim("boxes"), hx.template_b_claim("boxes")).alias("claim_text"),
        null.alias("claimant"),
        null.alias("claim_date"),
        null.alias("publisher_name"),
        null.alias("publisher_site"),
        hx.page_title("html").alias("review_title"),
        F.col("url").alias("review_url"),
        null.alias("review_date"),
        hx.result_of("boxes").alias("rating"),
        null.alias("language"),
    )
    claims = F.when(needs_html, F.array(fallback)).otherwise(F.col("found"))
    rows = read.select(
        "url",
        "edition",
        F.when(needs_html, F.lit(HTML_FALLBACK)).otherwise(F.lit(JSON_LD)).alias("method"),
        F.explode_outer(claims).alias("c"),
    )
    has_claim = F.col("c.claim_text").isNotNull()
    if not keep_empty:
        rows = rows.filter(has_claim)
    names = [n for n in schemas.RAW_COLUMNS if n != "matched_query"]
    filled = {
        "publisher_site": F.coalesce("c.publisher_site", publisher_domain(F.lit(None), "url")),
        "review_url": F.coalesce("c.review_url", "url"),
        "language": F.coalesce("c.language", "edition"),
    }
    return rows.select(
        *(filled.get(n, F.col(f"c.{n}")).alias(n) for n in names),
        null.alias("matched_query"),
        F.when(has_claim, F.col("method")).alias("extraction_method"),
    )


# Landmark name → pattern.
LANDMARKS = {
    "json_ld": r"(?i)<script[^>]*application/ld\+json",
    "claim": r"\bClaim\b",
    "fact": r"\bFact\b",
    "result": r"\b(?:RESULT|Result)\b",
    "verification": r"\bVerification\b",
}


def landmark_counts(pages, landmarks=None):
    """Count of each landmark per page."""
    return pages.select(
        "url",
        publisher_domain(F.lit(None), "url").alias("host"),
        *(
            F.regexp_count("html", F.lit(p)).cast("bigint").alias(name)
            for name, p in (landmarks or LANDMARKS).items()
        ),
    )


def profile_landmarks(pages, landmarks=None):
    """Per site: pages, and for each landmark its count and the pages that have it."""
    names = list(landmarks or LANDMARKS)
    return landmark_counts(pages, landmarks).groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        *(F.sum(n).alias(n) for n in names),
        *(F.count_if(F.col(n) > 0).alias(f"pages_with_{n}") for n in names),
    )

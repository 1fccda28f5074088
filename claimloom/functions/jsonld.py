"""schema.org ClaimReview blocks of a page as an array column."""

from pyspark.sql import functions as F

from claimloom.functions.text import _col, clean_text

BLOCK = r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"

# Public schema.org property paths per claim column; the first non-null wins.
PATHS = {
    "claim_text": ["$.claimReviewed"],
    "claimant": ["$.itemReviewed.author.name", "$.itemReviewed.author[0].name"],
    "claim_date": ["$.itemReviewed.datePublished"],
    "publisher_name": ["$.author.name", "$.author[0].name", "$.publisher.name"],
    "publisher_site": ["$.author.url", "$.author[0].url", "$.publisher.url"],
    "review_title": ["$.headline", "$.name"],
    "review_url": ["$.url"],
    "review_date": ["$.datePublished"],
    "rating": ["$.reviewRating.alternateName", "$.reviewRating.name"],
    "language": ["$.inLanguage"],
}


# Where an article keeps the review it is about.
INSIDE = ["$['@graph']", "$.review", "$.mainEntity"]


def _listed(item, path="$"):
    """What is at `path`: the elements of an array, or one value, null if there is none."""
    return F.coalesce(F.try_variant_get(item, path, "array<variant>"), F.array(F.try_variant_get(item, path, "variant")))


def _each(items, more):
    """Each of `items` followed by what `more` finds in it."""
    return F.flatten(F.transform(items, lambda x: F.concat(F.array(x), more(x))))


def _inner(item):
    """What the object holds at the INSIDE paths."""
    return F.concat(*(_listed(item, p) for p in INSIDE))


def _items(block):
    """Objects of one block: the object or the array of them, what their `@graph`, `review` or
    `mainEntity` holds, and what those hold in turn."""
    return _each(_listed(F.try_parse_json(block)), lambda x: _each(_inner(x), _inner))


def _is_claim_review(item):
    """`@type` is or lists ClaimReview, as a name or as the last part of an address."""
    one = F.try_variant_get(item, "$['@type']", "string")
    kinds = F.coalesce(F.try_variant_get(item, "$['@type']", "array<string>"), F.array(one))
    return F.exists(kinds, lambda k: F.coalesce(k.rlike(r"^(?:.*[/#:])?ClaimReview$"), F.lit(False)))


def claim_reviews(html):
    """Array of claim structs, one per ClaimReview; bad JSON is skipped.

    Pages without the marker never reach the pattern or the JSON parser.
    """
    page = _col(html)
    blocks = F.regexp_extract_all(page, F.lit(BLOCK), F.lit(1))
    items = F.filter(F.flatten(F.transform(blocks, _items)), _is_claim_review)

    def claim(item):
        fields = [
            F.coalesce(*(F.try_variant_get(item, p, "string") for p in paths))
            for paths in PATHS.values()
        ]
        fields[0] = clean_text(fields[0])
        return F.struct(*(f.alias(n) for f, n in zip(fields, PATHS)))

    found = F.filter(F.transform(items, claim), lambda c: c["claim_text"].isNotNull())
    return F.when(page.rlike(r"(?i)ld\+json"), found)

"""Derived columns of a merged claim."""

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions import text as tx
from claimloom.functions.text import _col

ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ].*(Z|[+-][0-9]{2}:?[0-9]{2})$"
ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
DATE_FORMATS = ("dd/MM/yyyy", "MMMM d, yyyy")


def claim_date_parsed(col, formats=DATE_FORMATS):
    """Date of an ISO-8601 text (its UTC day) or of one of `formats`, else null."""
    text = F.trim(_col(col))
    instant = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())
    iso = F.when(text.rlike(ZONED), instant.cast("date")).when(
        text.rlike(ISO_DAY), text.try_cast("date")
    )
    return F.coalesce(iso, *(F.try_to_date(text, f) for f in formats))


def publisher_domain(site, url):
    """Lower-case host of the site, else of the review address, without `www.`."""

    def host(c):
        return tx.non_blank(F.regexp_extract(
            F.lower(F.trim(_col(c))),
            r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?(?:www\.)?([^/:?#]+)",
            1,
        ))

    return F.coalesce(host(site), host(url))


def rating_clean(col):
    """Lower case, single spaces, no punctuation at the end; blank becomes null."""
    flat = F.lower(F.trim(F.regexp_replace(_col(col), tx.SPACE, " ")))
    return tx.non_blank(F.trim(F.regexp_replace(flat, r"[.!?,;:। ]+$", "")))


def language_name(col, names=schemas.LANGUAGE_NAMES):
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(col))


def has_claimant(col):
    return F.coalesce(F.trim(_col(col)) != "", F.lit(False))


def derived_columns(data_source="data_source"):
    """Name → Column for the eleven derived columns, in output order."""
    date = claim_date_parsed("claim_date")
    return {
        "claim_date_parsed": date,
        "claim_year": F.year(date),
        "claim_month": F.month(date),
        "publisher_domain": publisher_domain("publisher_site", "review_url"),
        "rating_clean": rating_clean("rating"),
        "language_name": language_name("language"),
        "claim_char_len": tx.char_len("claim_text"),
        "claim_word_len": tx.word_len("claim_text"),
        "detected_script": tx.detect_script("claim_text"),
        "has_claimant": has_claimant("claimant"),
        "data_source": _col(data_source),
    }


def derive_claims(df, data_source="data_source"):
    """Add all derived columns to claims."""
    return df.withColumns(derived_columns(data_source))

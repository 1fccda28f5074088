"""Explicit schemas. Nothing in this package infers a schema from data."""

from pyspark.sql import types as T


def strings(names):
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# The eleven columns of a collected claim, in output order.
RAW_COLUMNS = [
    "claim_text", "claimant", "claim_date", "publisher_name", "publisher_site",
    "review_title", "review_url", "review_date", "rating", "language", "matched_query",
]
RAW = strings(RAW_COLUMNS)

# The later twelve-column header. `language` must be last and `query` must come
# early for a short row to lose exactly its language; the rest is a default that
# callers may replace.
WIDE_COLUMNS = [
    "query", "query_lang", "claim_text", "claimant", "claim_date", "publisher_name",
    "publisher_site", "review_title", "review_url", "review_date", "rating", "language",
]

CORRUPT = "_corrupt_record"

DERIVED = T.StructType([
    T.StructField("claim_date_parsed", T.DateType()),
    T.StructField("claim_year", T.IntegerType()),
    T.StructField("claim_month", T.IntegerType()),
    T.StructField("publisher_domain", T.StringType()),
    T.StructField("rating_clean", T.StringType()),
    T.StructField("language_name", T.StringType()),
    T.StructField("claim_char_len", T.IntegerType()),
    T.StructField("claim_word_len", T.IntegerType()),
    T.StructField("detected_script", T.StringType()),
    T.StructField("has_claimant", T.BooleanType()),
    T.StructField("data_source", T.StringType()),
])
DERIVED_COLUMNS = DERIVED.fieldNames()

MERGED = T.StructType(RAW.fields + DERIVED.fields)
MERGED_COLUMNS = MERGED.fieldNames()

SCRAPED = T.StructType(RAW.fields + [T.StructField("extraction_method", T.StringType())])

REJECT = strings(["matched_query", "response", "reason"])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

PHRASE = T.StructType([
    T.StructField("phrase", T.StringType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("freq", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rank", T.IntegerType()),
])

# Language codes kept in the datasets and their display names.
LANGUAGE_NAMES = {"hi": "Hindi", "gu": "Gujarati", "mr": "Marathi"}
LANGUAGES = tuple(LANGUAGE_NAMES)

# Source labels. The first one is fixed; the other two name the collection routes.
EXTERNAL = "xfact_2021"
API = "google_factcheck_api"
ARCHIVE = "regional_archive"
SOURCE_PRIORITY = (EXTERNAL, API, ARCHIVE)

"""Scans. Every schema is explicit."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import schemas
from claimloom.sources.csvsplit import records

# Quoted line breaks and doubled quotes survive; values are not trimmed.
CSV_OPTIONS = {
    "multiLine": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def csv_header(spark, path):
    """Column names in the header of a CSV file, or of the first file of a folder."""
    return spark.read.options(**CSV_OPTIONS).csv(path, header=True, inferSchema=False).columns


def _marked_csv(spark, path, names, header):
    """All columns in file order and `_corrupt_record`, the raw text of a row with too few or too many fields.

    Every file's header must read the same: another one fails the job.
    """
    return (
        spark.read.schema(schemas.strings([*names, schemas.CORRUPT]))
        .options(**CSV_OPTIONS)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .csv(path, header=header, enforceSchema=not header)
    )


def _split_csv(spark, path, names, header):
    """What `_marked_csv` reads, by as many tasks as the files have splits."""
    rows = records(spark, path, header)
    fields = schemas.strings([*names, schemas.CORRUPT])
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT}
    return rows.select(F.explode_outer(F.array(F.from_csv("value", fields.simpleString(), options))).alias("row")).select("row.*")


def read_claims(spark, path, columns=schemas.RAW_COLUMNS, header=True, split=True):
    """Claims CSV: `columns`, found by name, and `_corrupt_record`; an empty field is null.

    A file whose header lacks one of the columns is refused; others it has are left out.
    Without a header the columns are those given, in order. A row with too few or too
    many fields keeps its raw text in `_corrupt_record`, so it can be counted or refused.

    A quoted value may span lines; by the number of quotes before a line `csvsplit` tells whether it does, so a file is
    as many tasks as it has splits. With `split=False` a file is one task, and quotes within unquoted values are allowed.
    """
    names = csv_header(spark, path) if header else list(columns)
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(names)}")
    read = _split_csv if split else _marked_csv
    return read(spark, path, names, header).select(*columns, schemas.CORRUPT)


def read_claims_ragged(spark, path, columns=schemas.WIDE_COLUMNS, header=True, split=True):
    """Claims CSV whose rows may hold fewer or more fields than the header, in file order.

    A short row keeps its fields, gets nulls at the end and its raw text in
    `_corrupt_record`; no row is dropped. The header may have `columns` in any order.
    """
    names = csv_header(spark, path) if header else list(columns)
    if sorted(names) != sorted(columns):
        raise ValueError(f"{path} has the header {', '.join(names)}, not {', '.join(columns)}")
    return (_split_csv if split else _marked_csv)(spark, path, names, header)


REVIEW = T.StructType([
    T.StructField("publisher", schemas.strings(["name", "site"])),
    *schemas.strings(["url", "title", "reviewDate", "textualRating", "languageCode"]).fields,
])
RESPONSE = T.StructType([
    T.StructField(
        "claims",
        T.ArrayType(T.StructType([
            *schemas.strings(["text", "claimant", "claimDate"]).fields,
            T.StructField("claimReview", T.ArrayType(REVIEW)),
        ])),
    )
])


def flatten_responses(df, response="response", query="matched_query"):
    """Landed search responses (JSON text) → one row per claim and review.

    A claim without reviews keeps its row; a response without claims has none.
    """
    claims = df.select(
        F.col(query).alias("matched_query"),
        F.explode_outer(F.from_json(response, RESPONSE)["claims"]).alias("c"),
    ).filter(F.col("c").isNotNull())
    reviews = claims.select("matched_query", "c", F.explode_outer("c.claimReview").alias("r"))
    return reviews.select(
        F.col("c.text").alias("claim_text"),
        F.col("c.claimant").alias("claimant"),
        F.col("c.claimDate").alias("claim_date"),
        F.col("r.publisher.name").alias("publisher_name"),
        F.col("r.publisher.site").alias("publisher_site"),
        F.col("r.title").alias("review_title"),
        F.col("r.url").alias("review_url"),
        F.col("r.reviewDate").alias("review_date"),
        F.col("r.textualRating").alias("rating"),
        F.col("r.languageCode").alias("language"),
        "matched_query",
    )


def response_rejects(df, response="response", query="matched_query"):
    """Landed responses that hold no answer: (matched_query, response, reason).

    `unreadable`: not a JSON object, or its claims are no array; `error`: an error envelope.
    A readable response without claims is an answer. Every response is either here or read
    by `flatten_responses`.
    """
    # The generators keep text and parsed body from being computed for every mention.
    texts = df.select(F.col(query).alias("matched_query"), F.explode_outer(F.array(response)).alias("response"))
    body = F.try_parse_json("response")
    kinds = F.struct(
        F.schema_of_variant(body).alias("body"), F.schema_of_variant(F.try_variant_get(body, "$.claims", "variant")).alias("claims"),
        F.try_variant_get(body, "$.error", "variant").isNotNull().alias("error"),
    )
    read = texts.select("*", F.inline_outer(F.array(kinds)))
    listed = F.coalesce(F.col("claims").startswith("ARRAY") | (F.col("claims") == "VOID"), F.lit(True))
    known = F.coalesce(F.col("body").startswith("OBJECT"), F.lit(False))
    reason = F.when(known & F.col("error"), "error").when(~(known & listed), "unreadable")
    return read.select("matched_query", "response", reason.alias("reason")).filter("reason is not null")


def read_pages(spark, path, schema=schemas.PAGE):
    """Landed archive pages."""
    return spark.read.schema(schema).parquet(path)


def read_corpus(spark, paths):
    """Text lines tagged by the language given per path: `{lang: path}`.

    `line_id` is a digest of language and text, so it does not depend on how the files
    are split; equal lines share it.
    """

    def one(lang, path):
        lines = spark.read.text(path, lineSep="\n")
        return lines.select(
            F.lit(lang).alias("lang"),
            F.md5(F.concat_ws(":", F.lit(lang), F.col("value"))).alias("line_id"),
            F.col("value").alias("text"),
        )

    return reduce(lambda a, b: a.unionByName(b), [one(k, v) for k, v in paths.items()])


def read_phrases(spark, path):
    """Phrase lists; language and method come from `{lang}_{method}` in the path.

    Reads both flat files (`hi_frequent_ngrams.csv`) and what `write_phrases` wrote. The
    columns are checked by name: a file with another header fails the job.
    """
    name = r"([a-z]{2,3})_(frequent_ngrams|yake_phrases)"
    lists = (
        spark.read.schema(schemas.PHRASE)
        .options(**CSV_OPTIONS)
        .option("recursiveFileLookup", True)
        .csv(path, header=True, enforceSchema=False)
    )
    file = F.col("_metadata.file_path")
    return lists.select(
        F.regexp_extract(file, name, 1).alias("lang"),
        F.regexp_extract(file, name, 2).alias("method"),
        "*",
    )


def map_source(df, mapping, data_source, columns=schemas.RAW_COLUMNS):
    """External labelled table → claim columns, by a `{target: source}` map."""
    unknown = set(mapping) - set(columns)
    if unknown:
        raise ValueError(f"not claim columns: {sorted(unknown)}")
    picked = [
        (F.col(mapping[c]) if c in mapping else F.lit(None)).cast("string").alias(c)
        for c in columns
    ]
    return df.select(*picked, F.lit(data_source).alias("data_source"))

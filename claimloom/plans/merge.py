"""Sources → one de-duplicated claims table."""

from functools import reduce

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions.claims import derive_claims
from claimloom.operators.clean import align, keep_languages
from claimloom.operators.dedupe import dedupe_by_url


def refuse_shifted(df):
    """Fail the job on the first row of a CSV scan that does not fit its header."""
    if schemas.CORRUPT not in df.columns:
        return df
    error = F.raise_error(F.lit("shifted rows: fields do not fit the header, run repair_shift first"))
    bad = F.col(schemas.CORRUPT).isNotNull()
    return df.filter(F.when(bad, error.cast("boolean")).otherwise(F.lit(True))).drop(schemas.CORRUPT)


def union_sources(sources, languages=schemas.LANGUAGES):
    """Claims of all sources (each with `data_source`) in the wanted languages."""
    wanted = {f.name: f for f in schemas.RAW.fields}
    wanted["data_source"] = schemas.DERIVED["data_source"]
    schema = schemas.T.StructType(list(wanted.values()))

    def one(df):
        if "query" in df.columns and "matched_query" not in df.columns:
            df = df.withColumnRenamed("query", "matched_query")
        return align(refuse_shifted(df), schema)

    return keep_languages(
        reduce(lambda a, b: a.unionByName(b), map(one, sources)), languages
    )


def merge_claims(sources, languages=schemas.LANGUAGES):
    """Union, de-duplicate by URL within the language, derive: the 22-column table."""
    merged = derive_claims(dedupe_by_url(union_sources(sources, languages)))
    return merged.select(*schemas.MERGED_COLUMNS)

"""Projection, filter, quality and repair operators. None of them shuffles."""

from pyspark.sql import functions as F

from claimloom import schemas

# What a data-frame CSV reader takes as missing by default.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

BOILERPLATE = (r"(?i)is an independent fact-checking initiative",)


def rename_query(df):
    return df.withColumnRenamed("matched_query", "query")


def keep_languages(df, languages=schemas.LANGUAGES):
    """Rows in one of `languages`; null and other languages are dropped."""
    return df.filter(F.col("language").isin(*languages))


def drop_missing(df, columns=None, markers=MISSING_MARKERS):
    """Rows with a value in every column; a marker counts as missing."""
    present = [
        F.col(c).isNotNull() & ~F.col(c).cast("string").isin(*markers)
        for c in columns or df.columns
    ]
    keep = present[0]
    for p in present[1:]:
        keep = keep & p
    return df.filter(keep)


def flag_boilerplate(df, patterns=BOILERPLATE, column="claim_text"):
    """Add `is_boilerplate`: the text matches one of the patterns."""
    any_of = "|".join(f"(?:{p})" for p in patterns)
    return df.withColumn(
        "is_boilerplate", F.coalesce(F.col(column).rlike(any_of), F.lit(False))
    )


def drop_boilerplate(df, patterns=BOILERPLATE, column="claim_text"):
    flagged = df if "is_boilerplate" in df.columns else flag_boilerplate(df, patterns, column)
    return flagged.filter(~F.col("is_boilerplate")).drop("is_boilerplate")


def row_kind(width=len(schemas.WIDE_COLUMNS)):
    """What the number of fields says of a row read under a header of `width` names.

    `complete`; `shifted` (exactly one field short: the old layout); `short` (more are
    missing); `long`; `unreadable` (the right number, and yet not read).
    """
    bare = F.regexp_replace(schemas.CORRUPT, r'"[^"]*"', "")
    fields = F.size(F.split(bare, ",", -1))
    return (
        F.when(F.col(schemas.CORRUPT).isNull(), "complete")
        .when(fields == width - 1, "shifted").when(fields < width, "short")
        .when(fields > width, "long").otherwise("unreadable")
    )


def shifted(width=len(schemas.WIDE_COLUMNS)):
    """A row with exactly one field less than the header; a complete row may have an empty language."""
    return row_kind(width) == "shifted"


def malformed(df, width=len(schemas.WIDE_COLUMNS)):
    """Rows that no repair puts right, with the `reason`."""
    kind = row_kind(width)
    return df.withColumn("reason", kind).filter(~F.col("reason").isin("complete", "shifted"))


def is_shifted(df):
    return df.withColumn("is_shifted", shifted())


def repair_shift(df, columns=None, insert_after="query"):
    """Move the fields after `insert_after` one place right in shifted rows.

    The column right of it, absent from the old layout, becomes null. `columns`: the
    header in file order, by default the order of `df`. Rows that `malformed` names are left out.
    """
    columns = columns or [c for c in df.columns if c in schemas.WIDE_COLUMNS]
    df = df.filter(row_kind(len(columns)).isin("complete", "shifted"))
    at = columns.index(insert_after) + 1
    out = []
    for i, name in enumerate(columns):
        if i < at:
            out.append(F.col(name))
        else:
            moved = F.lit(None).cast("string") if i == at else F.col(columns[i - 1])
            out.append(F.when(shifted(len(columns)), moved).otherwise(F.col(name)).alias(name))
    extra = [c for c in df.columns if c not in columns and c != schemas.CORRUPT]
    return df.select(*out, *extra)


def align(df, schema):
    """Exactly the columns of `schema`, cast; missing ones are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])

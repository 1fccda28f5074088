"""The corpus pipeline: stages that each apply one operator of `claimloom.llm` to what the last one kept.

Every stage but the last returns rows of `documents`, unchanged but for `secrets`,
which blacks out what it finds. Rows with nulls, repeated rows and rows without an
id are judged like any other; empty tables stay empty.
"""

import public_tokenizers
from pyspark.sql import functions as F

from claimloom.llm import bpe, decontaminate, secrets, simhash
from claimloom.llm import toxicity as toxic_language
from claimloom.llm.queries import RANKS, TOXIC, read
from claimloom.session import stored


def toxicity(spark, docs, sf_dir):
    """Documents that score below the threshold; the machine learns from those of `docs` that are labelled."""
    model = toxic_language.train(docs, read(spark, sf_dir, "labels"))
    return toxic_language.below(docs, model, TOXIC)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group linked by fingerprints of three-word shingles within two bits: that with the smallest doc_id."""
    return simhash.first_of_groups(docs, size=3, distance=2)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no window of a benchmark item, whole or nearly."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark, docs, sf_dir):
    """All documents, each secret replaced by its kind in brackets, and n_chars counted afresh."""
    return secrets.redacted(docs)


def tokens(spark, docs, sf_dir):
    """The documents with their token ids, and whether these decode to the text."""
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    decoded = bpe.with_ids(docs, ranks, public_tokenizers.PATTERN, into="tokens", decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("tokens", tokens),
]

#: SQL cannot express the trained machine, the hash of the fingerprints or the merges; tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The documents that all stages keep, as the last stage returns them."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus → ranked phrases → query list."""

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.operators.phrases import build_seeds, ngram_counts, sample_lines, top_phrases
from claimloom.operators.yake import (
    merge_yake, yake_batches, yake_phrases,
)


def ranked_phrases(docs, stopwords, top=200, batch_size=1000, id="doc_id",
                   languages=schemas.LANGUAGES):
    """Both phrase lists of every language in one frame."""
    batches = yake_batches(docs, batch_size, id, languages)
    scores = yake_phrases(batches, stopwords, id=id)
    keyed = merge_yake(scores, top).select(
        "lang", F.lit("yake_phrases").alias("method"), "phrase",
        F.lit(None).cast("int").alias("n"), F.lit(None).cast("bigint").alias("freq"),
        "score", "rank",
    )
    counted = top_phrases(ngram_counts(docs, stopwords=stopwords), top).select(
        "lang", F.lit("frequent_ngrams").alias("method"), "phrase", "n", "freq",
        F.lit(None).cast("double").alias("score"), "rank",
    )
    return counted.unionByName(keyed)


def query_list(docs, stopwords, seeds, sample=300_000, top=200, top_per_file=100,
               batch_size=1000, id="doc_id", languages=schemas.LANGUAGES):
    """Corpus sample to the query list of the next collection run."""
    sampled = sample_lines(docs, sample, id, languages)
    phrases = ranked_phrases(sampled, stopwords, top, batch_size, id, languages)
    return build_seeds(seeds, phrases, top_per_file)

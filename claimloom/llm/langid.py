"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over letter n-grams
tells the languages with a one from those with a zero; a text gets the language whose
codeword has the least loss, a bit weighing what its classifier is worth.
"""

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm.codes import chunks
from claimloom.llm.sample import first_by_digest
from claimloom.llm.spans import few, keyed
from claimloom.llm.worker import kept, portions
from claimloom.session import stored
from claimloom.sizing import spread

UNKNOWN = "und"
#: Hash buckets of each n-gram length, and the lengths.
BUCKETS = 1 << 12
ORDERS = (1, 2, 3)
#: What is learned from, at most: documents of a language. Every language is learned.
PER_LANG = 500
SMOOTH = 0.02
#: A second-best codeword with less than this much more loss makes a text ambiguous.
AMBIGUOUS = 0.5
#: Letters from which on more text makes a margin no surer.
SURE = 400
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def letters():
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(codes):
    """Places of the letters, and for each n-gram length the buckets of the n-grams that begin there."""
    is_letter = kept("letters", letters)[codes]
    at = np.flatnonzero(is_letter)
    shown = np.where(is_letter, codes, np.uint32(32)).astype(np.uint32)
    digest, found = np.zeros(len(at), np.uint32), []
    for n in ORDERS:
        digest = digest + shown[at + n - 1] * FACTORS[n - 1]
        mixed = (digest ^ (digest >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((mixed >> np.uint32(20)).astype(np.int64) + (n - 1) * BUCKETS)
    return at, found


def codewords(count):
    """One row of ±1 for each of `count` languages: all ways to part up to 7, else the best of random codes."""
    if count <= 7:
        bits = [(1, *b) for b in product((1, -1), repeat=count - 1) if -1 in b] if count else []
        return np.array(bits, np.float64).reshape(len(bits), count).T
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (count, int(np.ceil(10 * np.log2(count)))))
        code = code[:, np.abs(code.sum(0)) < count]
        apart = (code.shape[1] - np.max(code @ code.T - np.diag(np.full(count, np.inf)))) / 2
        if apart > far:
            best, far = code, apart
    return best


def training_rows(docs):
    """(doc_id, lang, text) of the documents that may be learned from."""
    return docs.filter("lang is not null and text is not null").filter(~held_out()).select("doc_id", "lang", "text")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def profiles(rows, per_lang=PER_LANG):
    """{language: mean relative n-gram frequencies}, of up to `per_lang` documents each.

    The documents are the first by a digest of their id; of rows with one language and id that with the lowest digest of its
    text. N-gram counts are summed by Spark; what comes to the driver is one number per language and bucket, 100 KB a language.
    """
    ids = first_by_digest(rows.select("doc_id", "lang"), "lang", "doc_id", per_lang)
    chosen = few(stored(ids.distinct(), "lang-sample"))
    drawn = rows.join(chosen, ["lang", "doc_id"], "left_semi")
    sample = drawn.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")

    def run(batches):
        sums = {}
        for batch in portions(batches, "text"):
            langs = batch.column("lang").to_pylist()
            counts = counted_grams(batch.column("text").to_pylist())
            for lang, row in zip(langs, counts):
                if row.sum():
                    total = sums.setdefault(lang, [np.zeros(len(row)), 0])
                    total[0] += row / row.sum()
                    total[1] += 1
        for lang, (total, n) in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": [*at.tolist(), -1], "total": [*total[at].tolist(), float(n)]})

    found = sample.mapInArrow(run, "lang string, bucket long, total double").groupBy("lang", "bucket").agg(F.sum("total").alias("total"))
    out = {}
    for lang, bucket, total in found.collect():
        out.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS + 1))[bucket] = total
    return {lang: x[:-1] / x[-1] for lang, x in sorted(out.items())}


def counted_grams(texts):
    out = np.zeros((len(texts), len(ORDERS) * BUCKETS), np.float32)
    for numbers, ends, codes in chunks(texts):
        at, found = grams(codes)
        of = numbers[np.searchsorted(ends, at, side="right")]
        for buckets in found:
            np.add.at(out, (of, buckets), 1)
    return out


class Model:
    """Weights of the bit classifiers and the codewords; its size depends on the number of languages only."""

    def __init__(self, found):
        self.langs = list(found)
        self.code = codewords(len(self.langs))
        if not found:
            self.weights, self.worth = np.zeros((len(ORDERS) * BUCKETS, 0), np.float32), np.zeros(0)
            return
        p = np.array([x * len(ORDERS) for x in found.values()]).reshape(len(self.langs), len(ORDERS) * BUCKETS)
        p = (p + SMOOTH / BUCKETS) / (1 + SMOOTH)
        ones = (self.code > 0).astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            yes, no = (ones.T @ p) / ones.sum(0)[:, None], ((1 - ones).T @ p) / (1 - ones).sum(0)[:, None]
        weights = np.clip(np.log(yes / no), -6, 6).T
        margin = self.code * (p @ weights) / len(ORDERS)
        size = np.maximum(np.abs(margin).mean(0), 1e-6)
        self.weights = (weights / size / len(ORDERS)).astype(np.float32)
        self.worth = np.clip(margin.min(0) / size, 0.05, None)
        self.worth = self.worth / self.worth.sum() if self.worth.size else self.worth

    def sums(self, texts):
        """(sums of the bits' margins over a text's letters, number of letters)."""
        total, n = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts), np.int64)
        for numbers, ends, codes in chunks(texts):
            at, found = grams(codes)
            cut = np.searchsorted(at, np.concatenate(([0], ends)))
            some = np.flatnonzero(np.diff(cut))
            np.add.at(n, numbers, np.diff(cut))
            if len(some) and self.weights.size:
                rows = self.weights[found[0]]
                for buckets in found[1:]:
                    rows += self.weights[buckets]
                np.add.at(total, numbers[some], np.add.reduceat(rows, cut[some], axis=0, dtype=np.float64))
        return total, n

    def predict(self, texts):
        """(language, score, ambiguous, letters) of each text."""
        total, n = self.sums(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), n
        mean = total / np.maximum(n, 1)[:, None] * np.sqrt(np.minimum(n, SURE))[:, None]
        # The loss log(1 + exp(-m * c)) of a bit c = -1 is that of c = 1 and m more.
        loss = (np.logaddexp(0, -mean) @ self.worth)[:, None] + (mean * self.worth) @ ((1 - self.code.T) / 2)
        ranked = np.sort(loss, axis=1)
        best = loss.argmin(1)
        odds = np.exp(ranked[:, :1] - ranked).sum(1)
        close = (ranked[:, 1] - ranked[:, 0] < AMBIGUOUS) if len(self.langs) > 1 else np.zeros(len(texts), bool)
        langs = [self.langs[b] if k else UNKNOWN for b, k in zip(best, n)]
        return langs, np.where(n > 0, 1 / odds, 0.0), close | (n == 0), n


def train(docs, per_lang=PER_LANG):
    """A Model of all languages of `docs` (doc_id, lang, text), held-out documents left aside."""
    return Model(profiles(training_rows(docs), per_lang))


def predict(docs, model, doc_id="doc_id", text="text"):
    """Language of every text: doc_id, version (digest of the text), lang_pred, score (0 to 1), ambiguous, n_letters.

    Only the text is looked at, and whole. A text that is null, empty or without letters
    is `und` with score 0, and ambiguous; so is every text if nothing was learned. A null
    doc_id keeps its row, repeated rows give equal rows. Ties go to the language that sorts
    first. Only the named columns are read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = keyed(spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = shared.value
        for batch in portions(batches, "text"):
            langs, score, close, n = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(close), pa.array(n, pa.int64())],
                ["doc_id", "version", "lang_pred", "score", "ambiguous", "n_letters"],
            )

    return texts.mapInArrow(run, f"doc_id {kind}, version long, lang_pred string, score double, ambiguous boolean, n_letters long")

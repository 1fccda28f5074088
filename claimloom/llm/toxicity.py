"""Toxicity by a support vector machine with a subsequence string kernel.

The strings are the words of a text's sentences: letters only, so signs put between
letters fall out, digits that stand for letters become them, and letters spelt one by
one are joined. The kernel of two strings sums over all subsequences of three letters
within five places, a gap costing DECAY, and is scaled by the strings' lengths. It is approximated
by Nystroem landmarks, strings of the training sentences; the machine is linear in the
landmark space. Since the kernel is linear in the subsequences, the machine folds into
one table of a weight per subsequence, so a word costs a few lookups a letter and no
comparison with landmarks.

Labels are those of whole documents: a labelled sentence is toxic if one of its strings is.
Training alternates between choosing the strings that make the toxic documents toxic and
fitting the machine, with the clean strings that score highest added as counterexamples.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm.codes import chunks
from claimloom.llm.sample import first_by_digest
from claimloom.llm.spans import keyed
from claimloom.llm.worker import kept, portions
from claimloom.sizing import spread

DECAY = 0.6
#: Distances of the second letter from the first and of the third from the second.
GAPS = [(1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1)]
#: Letters: a to z, and classes of all others.
OTHERS = 21
ALPHABET = 27 + OTHERS
#: Longer words are cut into strings of this many letters, each overlapping half of the next.
LONGEST = 24
BLANK, DROP = 0, 255
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}

#: Documents learned from at most, of each label; strings taken from them at most; landmarks.
PER_LABEL = 3000
CLEAN_STRINGS, TOXIC_STRINGS = 150_000, 3000
LANDMARKS = 256
COUNTER_EXAMPLES = 4000
ROUNDS = 3
#: Strings of a toxic document, the most toxic ones, that are taken to make it so.
BLAMED = 3
#: Toxic strings that are also learned with a letter put in.
STRETCHED = 100
#: Least worth of a string that may stand for a toxic document: the log ratio of its shares of toxic and clean
#: documents times the root of the number of toxic ones. Lower values arise by chance, and labels may be wrong.
TELLING = 8.0
COST = 10.0


def symbols():
    """Symbol of each code point: BLANK, DROP, or a letter's number."""
    table = np.full(0x110000, DROP, np.uint8)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c % OTHERS
        elif letter.isspace():
            table[c] = BLANK
    for digit, letter in LEET.items():
        table[ord(digit)] = ord(letter) - 96
    return table


def strings(codes, ends):
    """(letters, start, length, part) of the strings in `codes`, whose parts end at `ends`."""
    sign = kept("symbols", symbols)[codes]
    part = np.searchsorted(ends, np.arange(len(codes)), side="right")
    keep = sign != DROP
    sign, part = sign[keep], part[keep]
    blank = np.flatnonzero(sign == BLANK)
    before = np.diff(np.concatenate(([-1], blank))) - 1
    after = np.concatenate((before[1:], [len(sign) - 1 - blank[-1]] if len(blank) else []))
    glue = blank[(before == 1) & (after == 1)] if len(blank) else blank
    keep = np.ones(len(sign), bool)
    keep[glue] = False
    sign, part = sign[keep], part[keep]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sign == BLANK, [True])).astype(np.int8)))
    start, length = edge[::2], edge[1::2] - edge[::2]
    if len(length) and length.max() > LONGEST:
        start, length = cut(start, length)
    return sign, start, length, part[start] if len(start) else start


def cut(start, length):
    """Long words as overlapping strings of LONGEST letters."""
    pieces = np.maximum(-(-(length - LONGEST) // (LONGEST // 2)), 0) + 1
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(start, pieces) + nth * (LONGEST // 2)
    return begin, np.minimum(np.repeat(start + length, pieces) - begin, LONGEST)


def scale(length):
    """What divides the sum over the subsequences of a string: the norm of a string of that length without repeats."""
    total = sum(DECAY ** (2 * (a + b - 2)) * np.maximum(length - a - b, 0) for a, b in GAPS)
    return np.sqrt(np.maximum(total, 1))


def subsequences(sign, start, length):
    """For each gap: (string, code, weight) of the subsequences of the strings."""
    of = np.repeat(np.arange(len(start)), length)
    at = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
    place = at + np.repeat(start, length)
    left = np.repeat(length, length) - at
    letters = sign.astype(np.int32)
    for a, b in GAPS:
        ok = left > a + b
        p = place[ok]
        yield of[ok], (letters[p] * ALPHABET + letters[p + a]) * ALPHABET + letters[p + a + b], DECAY ** (a + b - 2)


def scores(weights, bias, sign, start, length):
    """Machine's value of each string."""
    total = np.zeros(len(start))
    for of, code, weight in subsequences(sign, start, length):
        total += weight * np.bincount(of, weights[code], len(start))
    return total / scale(length) + bias


def as_strings(words):
    """The arrays of `strings` for a list of words that are strings already."""
    numbers = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words], np.int64)
    return numbers, np.cumsum(length) - length, length


class Landmarks:
    """Landmark strings as scaled subsequence weights; row 0 stands for subsequences that none has."""

    def __init__(self, words):
        sign, start, length = as_strings(words)
        parts = list(subsequences(sign, start, length))
        self.codes = np.unique(np.concatenate([code for _, code, _ in parts]))
        self.row = np.zeros(ALPHABET ** 3, np.int32)
        self.row[self.codes] = np.arange(1, len(self.codes) + 1)
        self.table = np.zeros((len(self.codes) + 1, len(words)), np.float32)
        for of, code, weight in parts:
            np.add.at(self.table, (self.row[code], of), weight)
        self.table /= scale(length)

    def kernel(self, words, size=250):
        """Kernel of each word and each landmark, `size` words at a time."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for s in range(0, len(words), size):
            sign, start, length = as_strings(words[s:s + size])
            for of, code, weight in subsequences(sign, start, length):
                first = np.flatnonzero(np.diff(of, prepend=-1))
                if len(first):
                    out[s + of[first]] += weight * np.add.reduceat(self.table[self.row[code]], first, axis=0)
            out[s:s + len(start)] /= scale(length)[:, None]
        return out

    def fold(self, coefficients):
        """Weight of every subsequence in the sum of the landmarks' kernels with these coefficients."""
        weights = np.zeros(ALPHABET ** 3)
        weights[self.codes] = self.table[1:] @ coefficients
        return weights


def kernel(words, others):
    return Landmarks(others).kernel(words)


def fit_machine(z, y, weight):
    """(w, b) of a linear machine with squared hinge loss, by Newton's method; an unused row weighs nothing."""
    x = np.column_stack([z, np.ones(len(z))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) / COST
    ridge[-1, -1] = 1e-6
    value = lambda w: w @ ridge @ w / 2 + (weight * np.maximum(1 - y * (x @ w), 0) ** 2).sum() / 2
    for _ in range(50):
        short = 1 - y * (x @ w)
        use = short > 0
        xu = x[use] * weight[use, None]
        slope = ridge @ w - xu.T @ (y[use] * short[use])
        step = np.linalg.solve(ridge + xu.T @ x[use], slope)
        size, now = 1.0, value(w)
        while value(w - size * step) > now - 1e-4 * size * (slope @ step) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], w[-1]


class Model:
    """A weight per subsequence and the calibration; its size is fixed."""

    def __init__(self, weights, bias, line):
        self.weights, self.bias, self.line = weights.astype(np.float32), bias, line

    def evidence(self, texts):
        """(best, hits) of each text: the highest value of its strings, and how many are positive."""
        best, hits = np.full(len(texts), -3.0), np.zeros(len(texts))
        for numbers, ends, codes in chunks(texts):
            sign, start, length, part = strings(codes, ends)
            if len(start):
                value, of = scores(self.weights, self.bias, sign, start, length), numbers[part]
                np.maximum.at(best, of, value)
                hits += np.bincount(of, value > 0, len(texts))
        return best, hits

    def score(self, texts):
        best, hits = self.evidence(texts)
        slope, more, shift = self.line
        return 1 / (1 + np.exp(-np.clip(slope * np.clip(best, -3, 3) + more * np.log1p(hits) + shift, -30, 30)))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def known_labels(labels):
    """(doc_id, toxic) of the labelled documents that are not held out."""
    return labels.filter("toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def label_weights(labels, per_label=PER_LABEL):
    """Label → how many labelled documents each document of `labelled_sample` stands for."""
    counts = known_labels(labels).groupBy("toxic").count().collect()
    return {r["toxic"]: max(r["count"] / per_label, 1.0) for r in counts}


def labelled_sample(docs, labels, per_label=PER_LABEL):
    """(text, toxic) of up to `per_label` documents of each label that are not held out, first by a digest of the id."""
    known = known_labels(labels)
    chosen = first_by_digest(known, "toxic", "doc_id", per_label)
    return docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def string_counts(sample):
    """(word, toxic, clean): in how many toxic and clean texts each string of three letters or more occurs."""
    def run(batches):
        for batch in portions(batches, "text"):
            words, labels = [], []
            toxic = batch.column("toxic").to_pylist()
            for numbers, ends, codes in chunks(batch.column("text").to_pylist()):
                sign, start, length, part = strings(codes, ends)
                raw, seen = sign.tobytes(), set()
                for s, n, p in zip(start.tolist(), length.tolist(), numbers[part].tolist()):
                    if n > 2 and (p, word := raw[s:s + n]) not in seen:
                        seen.add((p, word))
                        words.append(word)
                        labels.append(toxic[p])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(labels, pa.int32())], ["word", "label"])

    return sample.mapInArrow(run, "word binary, label int").groupBy("word").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def document_strings(sample, words):
    """For each toxic text the numbers of those of its strings that are in `words`."""
    number = {w: i for i, w in enumerate(words)}
    shared = sample.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        for batch in portions(batches, "text"):
            found = {}
            for numbers, ends, codes in chunks(batch.column("text").to_pylist()):
                sign, start, length, part = strings(codes, ends)
                raw = sign.tobytes()
                for s, n, p in zip(start.tolist(), length.tolist(), numbers[part].tolist()):
                    if (i := shared.value.get(raw[s:s + n])) is not None:
                        found.setdefault(p, set()).add(i)
            yield pa.RecordBatch.from_arrays([pa.array([sorted(x) for x in found.values()], pa.list_(pa.int32()))], ["words"])

    return [r["words"] for r in sample.filter("toxic = 1").mapInArrow(run, "words array<int>").collect()]


def landmarks_of(words, worth, count):
    """Strings to compare with: half of the most telling ones, no two alike, and half of the commonest clean ones."""
    chosen = []
    for i in np.argsort(-worth, kind="stable"):
        if len(chosen) >= count // 2:
            break
        if not chosen or kernel([words[i]], [words[c] for c in chosen]).max() < 0.75:
            chosen.append(i)
    return [words[i] for i in chosen]


def train(docs, labels, per_label=PER_LABEL, landmarks=LANDMARKS):
    """A Model from a bounded sample of the labelled documents, held-out ones left aside.

    What comes to the driver: the TOXIC_STRINGS strings that most tell toxic texts, the
    CLEAN_STRINGS most frequent others, and for each sampled text its telling strings and two numbers.
    Without both labels every text scores the share of toxic ones, or 0.
    """
    sample = labelled_sample(docs, labels, per_label)
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    blank = np.zeros(ALPHABET ** 3)
    if not size.get(0) or not size.get(1):
        return Model(blank, -1.0, (0.0, 0.0, 30.0 if size.get(1) else -30.0))
    counts = string_counts(sample)
    tell = F.log((F.col("toxic") + 0.5) / size[1]) - F.log((F.col("clean") + 0.5) / size[0])
    top = counts.filter("toxic > 0").select("word", (tell * F.sqrt("toxic")).alias("worth")).orderBy(F.desc("worth"), "word").limit(TOXIC_STRINGS).collect()
    clean = counts.filter("clean > 0").orderBy(F.desc("clean"), "word").limit(CLEAN_STRINGS).select("word").toArrow()
    words, worth = [bytes(r["word"]) for r in top], np.array([r["worth"] for r in top])
    bags = document_strings(sample, words)
    negative = clean.column("word").to_pylist()
    common = negative[:landmarks // 2]
    model = fit(words, worth, bags, negative, landmarks_of(words, worth, landmarks) + common)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in portions(batches, "text"):
            best, hits = shared.value.evidence(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(hits), batch.column("toxic")], ["best", "hits", "toxic"])

    rows = np.array(sample.mapInArrow(run, "best double, hits double, toxic int").collect(), np.float64).reshape(-1, 3)
    x = np.column_stack([np.clip(rows[:, 0], -3, 3), np.log1p(rows[:, 1]), np.ones(len(rows))])
    stands_for = label_weights(labels, per_label)
    model.line = calibrated(x, rows[:, 2], np.where(rows[:, 2] > 0, stands_for[1], stands_for[0]))
    return model


def stretched(words):
    """Each word with one letter put in at each inner place, as insults are written to slip through."""
    rng = np.random.default_rng(11)
    return [w[:i] + bytes([rng.integers(1, 27)]) + w[i:] for w in words for i in range(1, len(w))]


def fit(words, worth, bags, negative, chosen_landmarks):
    """Alternates between the toxic documents' telling strings and the machine."""
    number = {w: i for i, w in enumerate(words)}
    clean = [w for w in negative if w not in number]
    known = worth >= TELLING
    everything = words + clean
    landmarks = Landmarks(chosen_landmarks)
    value, vector = np.linalg.eigh(landmarks.kernel(chosen_landmarks).astype(np.float64))
    root = vector[:, value > 1e-4] / np.sqrt(value[value > 1e-4])
    z_toxic = landmarks.kernel(words) @ root
    sign, start, length = as_strings(everything)
    rank = np.where(known, worth, -np.inf)
    chosen = np.arange(min(COUNTER_EXAMPLES // 2, len(clean)))
    for _ in range(ROUNDS):
        picked = np.zeros(len(words))
        for bag in bags:
            for i in sorted(bag, key=lambda i: -rank[i])[:BLAMED]:
                picked[i] += np.isfinite(rank[i])
        longer = stretched([words[i] for i in np.argsort(-picked, kind="stable")[:STRETCHED] if picked[i] > 1])
        counter = [clean[i] for i in chosen]
        z = np.vstack([z_toxic, landmarks.kernel(longer + counter) @ root])
        y = np.concatenate([np.where(picked > 0, 1.0, -1.0), np.ones(len(longer)), -np.ones(len(counter))])
        weight = np.concatenate([np.sqrt(picked), np.full(len(longer), 0.5), np.ones(len(counter))])
        w, bias = fit_machine(z, y, weight)
        weights = landmarks.fold(root @ w)
        found = scores(weights, bias, sign, start, length)
        rank = np.where(known | (found[:len(words)] > 0), found[:len(words)], -np.inf)
        hardest = np.argsort(-found[len(words):], kind="stable")[:COUNTER_EXAMPLES // 2]
        chosen = np.union1d(chosen, hardest)[:2 * COUNTER_EXAMPLES]
    return Model(weights, bias, (0.0, 0.0, 0.0))


def calibrated(x, y, weight):
    """(slope, weight of hits, shift) of a logistic line with a small ridge, each row as often as `weight` says.

    With `label_weights` both labels weigh as they occur in the whole table, so a score means the same at every size.
    """
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.1 * w
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + 0.1 * np.eye(len(w)), slope)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def score(docs, model, doc_id="doc_id", text="text"):
    """Toxicity of every text: doc_id, version (digest of the text), score (0 to 1, higher is more toxic).

    Only the text is looked at, and whole. A null or empty text, or one without a word of
    three letters, has the score of a text with no toxic string. A null doc_id keeps its
    row, repeated rows give equal rows. Only the named columns are read. An empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = keyed(spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in portions(batches, "text"):
            found = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(found)], ["doc_id", "version", "score"])

    return texts.mapInArrow(run, f"doc_id {kind}, version long, score double")


def below(docs, model, threshold, text="text"):
    """Rows of `docs`, unchanged, whose text scores below `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in portions(batches, text):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(shared.value.score(texts) < threshold))

    return spread(docs).mapInArrow(run, docs.schema)

"""Phrase collocations by Toivonen's method.

A sample of the pieces of text proposes the phrases that are frequent in it at a lowered
threshold. The full pass counts them and their negative border - the phrases that were not
proposed, but whose every part was. What turns out frequent in the border may belong to longer
frequent phrases that nobody has counted, so an expansion pass counts what such failures leave
open, until the border is closed.

The passes tell phrases by 64-bit digests and test them against bitmaps of digests. A bit that is set by another
digest has more phrases counted, never fewer. Each frequent phrase is spelt out by one portion of text only, the one with
the least number among those that hold it, as the counting found. Last the phrases of the result and the halves they were
cut into are counted by themselves; if a count differs, two phrases share a digest, and all frequent phrases are counted so.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.llm.worker import kept, portions
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small, spread

#: Words of a phrase at most.
LONGEST = 5
#: One piece in so many is in the sample; its threshold lies so many standard deviations below the expected count.
SAMPLE, BELOW = 4, 4
#: Bytes of a piece that are drawn together.
DRAWN = 128
#: Bits of a bitmap for each digest in it, and the most bits (64 MB); beyond these more phrases pass, and are counted.
BITS, MOST_BITS = 32, 29
#: Bytes of text that are worked on at once, and digests that a task adds up before it hands them on.
TEXTS, HELD = 4 << 20, 1_000_000
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
LETTERS = bytes.maketrans(bytes(range(65, 91)) + b"\t" + SEPARATORS, bytes(range(97, 123)) + b" " + b"\n" * len(SEPARATORS))
FACTOR, PROBES = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def words_of(texts, share=1):
    """(codes, names): each word of the texts (bytes) as the number of its name, -1 between pieces.

    Of one piece in `share`, drawn by lot, so that copies, lines that a text repeats and, as long pieces are cut for
    it, words that a piece repeats are drawn apart. A cut hides some phrases from the sample, not from the passes.
    """
    data = b"\n".join(texts).translate(LETTERS)
    if share > 1:
        pieces = [piece[k:k + DRAWN] for piece in data.split(b"\n") for k in range(0, len(piece), DRAWN)]
        lots = np.random.default_rng(zlib.crc32(data)).integers(0, share, len(pieces))
        data = b"\n".join([pieces[k] for k in np.flatnonzero(lots == 0).tolist()])
    data = data.replace(b"\n", b" \n ") + b" "
    ends = (np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1).astype(np.int32)
    offsets = pa.py_buffer(np.append(np.int32(0), ends).tobytes())
    cut = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    names = [name[:-1] for name in cut.dictionary.to_pylist()]
    number = np.arange(len(names), dtype=np.int32)
    for k, name in enumerate(names):
        if name == b"":
            number[k] = -2
        elif name == b"\n":
            number[k] = -1
    codes = number[cut.indices.to_numpy()]
    return codes[codes != -2], names


def digests(names, lang):
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh3_64_intdigest(name, seed) for name in names], np.uint64)


class Bitmap:
    """A set of digests that may say yes to others."""

    def __init__(self, data):
        self.bits = np.frombuffer(data, np.uint8)
        self.shift = np.uint64(64 - (len(data) * 8).bit_length() + 1)

    def has(self, digests):
        out = np.ones(len(digests), bool)
        for probe in PROBES:
            at = (digests * probe) >> self.shift
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def candidates(codes, own, known, failed=None, longest=LONGEST, tested=LONGEST):
    """For each length from 2 on: (length, places, digests) of the phrases whose parts are all in `known`, or hold one in `failed`.

    `own`: digests of the words; without `known` all are. Parts of more than `tested` words are not looked up.
    """
    inside, lost = codes >= 0, np.zeros(len(codes), bool)
    if failed is not None:
        lost = inside & failed.has(own)[codes]
    if known is not None and tested >= 1:
        inside &= known.has(own)[codes] | lost
    at = np.flatnonzero(inside[:-1] & inside[1:])
    now, lost = own[codes[at]] * FACTOR + own[codes[at + 1]], lost[at] | lost[at + 1]
    yield 2, at, now
    for length in range(3, longest + 1):
        if known is not None and tested >= length - 1:
            good = known.has(now)
            if failed is not None:
                lost |= failed.has(now)
                good |= lost
            at, now, lost = at[good], now[good], lost[good]
        pairs = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, now, lost = at[pairs], now[pairs], lost[pairs] | lost[pairs + 1]
        now = now * FACTOR + own[codes[at + length - 1]]
        yield length, at, now


def by_language(batches):
    """(lang, texts, number) of portions of batches; null is `und`, a null text empty. The number is a digest of the texts."""
    for batch in portions(batches, "text", TEXTS):
        langs, texts = pc.fill_null(batch.column("lang"), "und"), batch.column("text").cast(pa.binary())
        for lang in langs.unique():
            own = [x or b"" for x in texts.filter(pc.equal(langs, lang)).to_pylist()]
            yield lang.as_py().encode(), own, np.uint64(xxhash.xxh3_64_intdigest(b"\n".join(own)))


def added(digests, lengths, counts, portions):
    """The same with each digest once: its length, count and least portion."""
    order = np.argsort(digests, kind="stable")
    digests = digests[order]
    first = np.flatnonzero(np.append(True, digests[1:] != digests[:-1]))
    return digests[first], lengths[order][first], np.add.reduceat(counts[order], first), np.minimum.reduceat(portions[order], first)


class Sums:
    """Counts of digests, handed on when there are too many of them to hold."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, digests, length, portion):
        if len(digests):
            ranked = np.sort(digests)
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            self.put(ranked[first], length, np.diff(np.append(first, len(ranked))), portion)

    def put(self, digests, length, counts, portion):
        number = np.full(len(digests), portion, np.uint64).view(np.int64)
        self.parts.append((digests, np.full(len(digests), length, np.int8), counts.astype(np.int32), number))
        self.size += len(digests)

    def rows(self, last=False):
        if not self.size or not (last or self.size > HELD):
            return
        found = added(*(np.concatenate(x) for x in zip(*self.parts)))
        if not last and len(found[0]) < HELD // 2:
            self.parts, self.size = [found], len(found[0])
            return
        self.parts, self.size = [], 0
        digests, lengths, counts, numbers = found
        for k in range(0, len(digests), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[part].view(np.int64)), pa.array(lengths[part]), pa.array(counts[part].astype(np.int64)), pa.array(numbers[part])],
                ["digest", "length", "count", "portion"])


def counted(docs, least, shortest=1, longest=LONGEST, known=None, failed=None, tested=LONGEST, share=1):
    """(digest, length, count, portion) of phrases that occur `least` times or more, of those whose parts are all in `known`.

    With `failed`, those that hold such a phrase take the place of these. Words are counted if `shortest` is 1. `share`: one piece in so many is looked at.
    """
    def run(batches):
        kept("collocations")
        old, lost = (x and Bitmap(x.value) for x in (known, failed))
        sums = Sums()
        for lang, texts, portion in by_language(batches):
            codes, names = words_of(texts, share)
            if not len(codes):
                continue
            own = digests(names, lang)
            if shortest == 1:
                occur = np.bincount(codes[codes >= 0], minlength=len(names))
                sums.put(own[occur > 0], 1, occur[occur > 0], portion)
            done = candidates(codes, own, old, None, longest) if lost else None
            for length, at, found in candidates(codes, own, old, lost, longest, tested):
                if done:
                    found = found[~np.isin(at, next(done)[1], assume_unique=True)]
                if length >= shortest:
                    sums.add(found, length, portion)
            yield from sums.rows()
        yield from sums.rows(last=True)

    rows = docs.mapInArrow(run, "digest long, length byte, count long, portion long")
    found = rows.groupBy("digest").agg(F.max("length").alias("length"), F.sum("count").alias("count"), F.min("portion").alias("portion"))
    return found.filter(F.col("count") >= least)


def bits_for(number):
    """The power of two bits, at least 2^16, of a bitmap for so many digests."""
    return min(max((number * BITS).bit_length(), 16), MOST_BITS)


def bitmap(found, bits):
    """The bytes, 2^bits / 8, of the bitmap of the column `digest`; tasks make 8 KB each."""
    def places(batches):
        for batch in batches:
            own = batch.column("digest").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([(own * probe) >> np.uint64(64 - bits) for probe in PROBES])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 16), pa.array(at & 0xFFFF)], ["block", "bit"])

    def block(table):
        out = np.zeros(1 << 16, bool)
        out[table.column("bit").to_numpy()] = True
        return pa.table({"block": table.column("block")[:1], "data": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    at = found.select("digest").mapInArrow(places, "block long, bit long").distinct()
    out = bytearray(1 << bits - 3)
    for row in at.groupBy("block").applyInArrow(block, "block long, data binary").toLocalIterator():
        out[row["block"] << 13:(row["block"] + 1) << 13] = row["data"]
    return bytes(out)


def sampled(docs, least, share=SAMPLE):
    """The digests of the phrases that are frequent, at a lowered threshold, in one piece in `share`."""
    expected = least / share
    least = max(2, int(expected - BELOW * expected ** 0.5)) if share > 1 else least
    short = stored(counted(docs, least, longest=2, share=share), "sample-pairs")
    filter_of = _shared(docs, bitmap(short, bits_for(short.count())))
    long = counted(docs, least, shortest=3, known=filter_of, tested=2, share=share)
    found = stored(short.union(long), "proposed-phrases")
    filter_of.unpersist()
    return found


def _shared(docs, data):
    return docs.sparkSession.sparkContext.broadcast(data)


def frequent(docs, least, share=SAMPLE):
    """(digest, length, count, portion) of all phrases of up to LONGEST words with `least` occurrences or more, and some more.

    `docs`: (lang, text). Two phrases that share a digest are counted together. The border of what was proposed fails
    where it holds a frequent phrase. The expansion then counts all phrases that hold a failure and whose other parts
    are known, of any length, and so closes at once: a frequent phrase that neither pass counted would have a
    shortest one in it, both of whose parts are known or hold a failure, and such are counted.
    """
    known = sampled(docs, least, share).select("digest")
    proposed = _shared(docs, bitmap(known, bits_for(known.count())))
    found = stored(counted(docs, least, known=proposed), "counted-phrases")
    failed = stored(found.filter(F.col("length") < LONGEST).join(known, "digest", "left_anti").select("digest"), "border-failures")
    failures = failed.count()
    if failures:
        lost = _shared(docs, bitmap(failed, bits_for(failures)))
        found = found.union(stored(counted(docs, least, shortest=2, known=proposed, failed=lost), "expanded-phrases"))
        lost.unpersist()
    proposed.unpersist()
    return found


def marks(digests, portions):
    """One digest of a phrase and a portion."""
    return (digests ^ (portions * PROBES[0])) * FACTOR


def spelt(docs, found, named=None):
    """(lang, phrase, length, digest, count) of the phrases with a digest in `found`, and a row without a phrase for the words of each portion.

    With `named`, digests of phrases and portions, only those portions spell them out; else all do.
    """
    shared = _shared(docs, bitmap(found, bits_for(found.count())))
    owners = named and _shared(docs, bitmap(named, bits_for(named.count())))

    def run(batches):
        kept("collocations")
        known, mine = Bitmap(shared.value), owners and Bitmap(owners.value)
        for lang, texts, portion in by_language(batches):
            codes, names = words_of(texts)
            words = codes >= 0
            rows = [(None, 0, 0, int(words.sum()))]

            def wanted(digests):
                good = known.has(digests)
                return good & mine.has(marks(digests, portion)) if mine else good

            if len(codes):
                own = digests(names, lang)
                occur = np.bincount(codes[words], minlength=len(names))
                for k in np.flatnonzero((occur > 0) & wanted(own)):
                    rows.append((names[k], 1, int(own.view(np.int64)[k]), int(occur[k])))
                for length, at, now in candidates(codes, own, known):
                    now, first, times = np.unique(now, return_index=True, return_counts=True)
                    good = wanted(now)
                    for digest, place, n in zip(now.view(np.int64)[good].tolist(), at[first[good]].tolist(), times[good].tolist()):
                        rows.append((b" ".join([names[c] for c in codes[place:place + length].tolist()]), length, digest, n))
            for k in range(0, len(rows), 20_000):
                phrases, lengths, all_digests, counts = zip(*rows[k:k + 20_000])
                text = pa.array(phrases, pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.decode()] * len(text)), text, pa.array(lengths, pa.int32()), pa.array(all_digests, pa.int64()), pa.array(counts, pa.int64())],
                    ["lang", "phrase", "length", "digest", "count"])

    return docs.mapInArrow(run, "lang string, phrase string, length int, digest long, count long")


def named_counts(docs, found):
    """(lang, phrase, length, count) of the frequent phrases by the counts of their digests, and a row without a phrase for each language."""
    def run(batches):
        for batch in batches:
            one, two = (batch.column(c).to_numpy().view(np.uint64) for c in ("digest", "portion"))
            yield pa.RecordBatch.from_arrays([pa.array(marks(one, two).view(np.int64))], ["digest"])

    owners = stored(found.select("digest", "portion").mapInArrow(run, "digest long"), "phrase-portions")
    rows = stored(spelt(docs, found, owners), "spelt-phrases")
    names = rows.filter("phrase is not null").select("lang", "phrase", "length", "digest").distinct()
    totals = rows.filter("phrase is null").groupBy("lang", "phrase", "length").agg(F.sum("count").alias("count"))
    counts = found.groupBy("digest").agg(F.max("count").alias("count"))
    return names.join(counts, "digest").select("lang", "phrase", "length", "count").union(totals)


def whole_counts(docs, found, least=1):
    """(lang, phrase, length, count) of the phrases with a digest in `found`, each counted by itself, and a row without a phrase for each language."""
    rows = spelt(docs, found).groupBy("lang", "phrase").agg(F.max("length").alias("length"), F.sum("count").alias("count"))
    return rows.filter(F.col("phrase").isNull() | (F.col("count") >= least))


def parts_of(words, length, shortest=1):
    """The array of all shorter runs of `words`, an array column of up to LONGEST words, of `shortest` words or more."""
    runs = F.array(*(
        F.when((F.lit(size) < length) & (F.lit(start + size) <= length), F.array_join(F.slice(words, start + 1, size), " "))
        for size in range(shortest, LONGEST) for start in range(LONGEST - size + 1)
    ))
    return F.array_distinct(F.filter(runs, lambda x: x.isNotNull()))


def scored(counts, share=100):
    """The candidates of `counts` (see `whole_counts`) with the halves, l, r, n and score of their worst cut, without those inside longer ones."""
    phrases = counts.filter("phrase is not null").select("lang", "phrase", "length", F.col("count").alias("a"))
    totals = counts.filter("phrase is null").select("lang", F.col("count").alias("n"))
    long = phrases.filter("length > 1").withColumn("words", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    cuts = long.select("lang", "phrase", "length", "a", "words", cut).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("length")), " ").alias("rest"))
    known = broadcast_if_small(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times")))
    one, two = known.toDF("lang", "first", "l"), known.toDF("lang", "rest", "r")
    big = lambda c: F.col(c).cast("decimal(16,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * big("a") * big("n"), big("l") * big("r"))
    worst = cuts.join(one, ["lang", "first"]).join(two, ["lang", "rest"]).join(broadcast_if_small(totals), "lang").groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n", "first", "rest")).alias("it"))
    inside = long.filter("length > 2").select(
        "lang", F.col("a").alias("longer"), F.explode(parts_of(F.col("words"), F.col("length"), 2)).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = worst.join(inside, ["lang", "phrase"], "left")
    left = left.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("it.a")))
    return left.select("lang", "phrase", "it.a", "it.l", "it.r", "it.n", "it.score", "it.first", "it.rest")


def best(counts, inside, top):
    """The `top` candidates of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts, inside).withColumn("rank", F.row_number().over(order).cast("long"))
    return stored(ranked.filter(F.col("rank") <= top), "ranked-phrases")


def agree(docs, ranked):
    """Whether the phrases of a result and their halves, counted by themselves, have the counts it gives."""
    each = F.array(*(F.struct(F.col(name).alias("phrase"), F.col(n).alias("times")) for name, n in (("phrase", "a"), ("first", "l"), ("rest", "r"))))
    told = stored(ranked.select("lang", F.inline(each)).distinct(), "told-counts")

    def run(batches):
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist()):
                words = [int(x) for x in digests(phrase.split(b" "), lang.encode())]
                for start in range(len(words)):  # all its parts, without which it is not looked for
                    part = words[start]
                    out.append(part)
                    for word in words[start + 1:]:
                        part = (part * int(FACTOR) + word) % (1 << 64)
                        out.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64))], ["digest"])

    asked = stored(told.select("lang", "phrase").mapInArrow(run, "digest long").distinct(), "told-digests")
    real = whole_counts(docs, asked).filter("phrase is not null").select("lang", "phrase", F.col("count").alias("times"))
    return told.join(real, ["lang", "phrase", "times"], "left_anti").isEmpty()


def collocations(docs, least=100, top=2000, inside=100, share=SAMPLE, text="text", lang="lang"):
    """The `top` phrases of two to five words of each language by how much more often they occur than their halves let expect.

    Columns: lang, rank (from 1, by score and a descending, then phrase in UTF-8 order), phrase (words with one blank
    between), a (occurrences), l, r (occurrences of the two halves of the cut with the lowest score, the first such), n
    (words of the language), score (floor of 1000 a n / (l r), exact).

    Words are what blanks and tabs part, A-Z lower-cased; phrases do not cross `.,;:!?` or line ends. All occurrences
    count, overlapping ones too. Candidates have `least` occurrences; those inside a longer candidate with at
    least `inside` per cent of their occurrences are left out. A null text is empty, a null lang is `und`, one language with that
    of that name; repeated rows count each. Only the named columns are read. An empty table, and a language without candidates, gives no rows.

    Counts are of whole texts of all documents, by 64-bit digests; those of the result are held against counts of the
    phrases themselves, and if they differ all are counted so. `share` sets how large the sample is (one piece in so many), which
    changes the work and not the result.
    """
    rows = spread(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")))
    found = frequent(rows, least, share)
    counts = stored(named_counts(rows, found), "phrase-counts")
    ranked = best(counts, inside, top)
    if not agree(rows, ranked):
        ranked = best(stored(whole_counts(rows, found.select("digest"), least), "phrase-counts"), inside, top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

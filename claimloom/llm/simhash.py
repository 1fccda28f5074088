"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 1 bit in one
of their halves. The anchors of a half are the words of the Hamming code over its low
31 bits, which has covering radius 1: every value is within one bit of just one
anchor. A fingerprint is replicated to all anchors within radius plus threshold, two
bits: 15.5 of 2^26 on average, for each half. Of two such fingerprints, the
nearest anchor of the one is always among the anchors of the other, and there they are
compared in full.
"""

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from claimloom.llm.components import components
from claimloom.llm.spans import few, keyed
from claimloom.llm.worker import kept as kept_by_worker
from claimloom.llm.worker import portions
from claimloom.session import stored
from claimloom.sizing import spread

SEED = 42
#: The half's threshold that the cover is built for, by which the whole threshold is bound.
MAX_DISTANCE = 3
#: Digests that are counted at once, so that a very long text needs no more memory than a short one.
CHUNK = 100_000


def shingle_hashes(words, size):
    """XXH64 of each shingle; the whole sequence is the only one of fewer words, and no words have none."""
    for start in range(max(len(words) - size + 1, min(len(words), 1))):
        yield xxhash.xxh64_intdigest(b" ".join(words[start:start + size]), SEED)


def fingerprint(text, size=3):
    """64 bits, as a signed number, of a text in UTF-8: bit i is set if it is in over half the hashes.

    For bytes, lower() and split() know A-Z and the six ASCII blanks only.
    """
    hashes = shingle_hashes(text.lower().split(), size)
    total, ones = 0, np.zeros(64, np.int64)
    while len(part := np.fromiter(islice(hashes, CHUNK), "<u8")):
        total += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs, size=3, doc_id="doc_id", text="text"):
    """(doc_id, version, fp): one row per row of `docs`."""
    texts = keyed(spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))

    def run(batches):
        kept_by_worker("simhash")
        for batch in portions(batches, "text"):
            found = [fingerprint(x.as_py(), size) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(found, pa.int64())], ["doc_id", "version", "fp"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, version long, fp long")


def syndrome(half):
    """Of the 31-bit Hamming code: the place, from 1, of the bit that is off the nearest anchor; 0 on an anchor."""
    out = F.lit(0)
    for k in range(5):
        covered = sum(1 << (place - 1) for place in range(1, 32) if place >> k & 1)
        out = out + (F.bit_count(half.bitwiseAND(F.lit(covered))) % 2) * (1 << k)
    return out


def flip(half, place):
    """`half` with the bit at `place`, from 1, turned; place 0 turns none."""
    return half.bitwiseXOR(F.call_function("shiftright", F.call_function("shiftleft", F.lit(1).cast("long"), place), F.lit(1)))


def anchors(half):
    """All anchors within two bits: the nearest, and with two bits turned whose places add up to the syndrome."""
    off = syndrome(half)
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda a: (off != 0) & (a < a.bitwiseXOR(off)))
    return F.concat(F.array(flip(half, off)), F.transform(pairs, lambda a: flip(flip(half, a), a.bitwiseXOR(off))))


def halves(fps):
    """(fp, side, low): the low 31 bits of both halves."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(0x7FFFFFFF).alias("low")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("fp", 32).bitwiseAND(0x7FFFFFFF).alias("low")),
    )
    return fps.select("fp", F.inline(sides))


def links(fps, distance=2):
    """(a, b): distinct pairs of the distinct fingerprints `fp` that differ in at most `distance` bits, a < b."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"the halves are covered for distances up to {MAX_DISTANCE}")
    sides = halves(fps)
    home = sides.select("fp", "side", flip(F.col("low"), syndrome(F.col("low"))).alias("anchor"))
    visit = sides.select(F.col("fp").alias("other"), "side", F.explode_outer(anchors(F.col("low"))).alias("anchor"))
    close = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
    # Spark takes the 15.5 anchors of a row for one and would broadcast them all.
    met = home.join(visit.hint("merge"), (home["side"] == visit["side"]) & (home["anchor"] == visit["anchor"]) & close)
    return met.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def near_duplicates(docs, size=3, distance=2, doc_id="doc_id", text="text"):
    """Groups of documents whose fingerprints are linked, directly or through others.

    Columns: doc_id, version (digest of the text), fp (signed 64 bits), component_id
    (smallest doc_id of the group), kept (whether the row is the first of its group, by doc_id, then version).

    Equal fingerprints are one node, so a group of copies of any size costs one row
    per task before the shuffle; only different fingerprints are linked, each with at
    most 2,080 others within two bits. A null text, an empty one or one of blanks has
    fingerprint zero and is grouped like any other. A null doc_id keeps its row and
    comes last: a group of such rows alone has a null component_id. Rows with one id and
    other texts are fingerprinted apart. Repeated rows have equal values. Only the named columns are read. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, size, doc_id, text), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "version")
    distinct = stored(rows.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        distinct["fp"], "first", F.coalesce("root", distinct["fp"]).alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    return rows.join(named, "fp").select("doc_id", "version", "fp", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def first_of_groups(docs, find=near_duplicates, **params):
    """Rows of `docs`, unchanged: the first document of each group that `find` makes, repeated rows once.

    Only keys of documents that go, and of those that are repeated, meet the texts. Other columns may have any names; of repeated
    rows that differ in them any one stays. Rows without an id, or with one id and other texts, are told apart by their texts.
    """
    key = ["doc_id", "version"]
    marked = find(docs, **params).groupBy(key).agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    marked = stored(marked.filter("not kept or times > 1"), "marked-documents")
    version = F.xxhash64(F.coalesce(F.col("a.text"), F.lit("")))

    def beside(keys, how):
        return docs.alias("a").join(few(keys).alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (version == F.col("b.version")), how)

    once, again = beside(marked, "left_anti"), marked.filter("kept")
    if again.isEmpty():
        return once
    row = F.first(F.struct(*(F.col(f"a.`{c}`").alias(c) for c in docs.columns))).alias("row")
    return once.union(beside(again, "left_semi").groupBy(F.col("a.doc_id"), version).agg(row).select("row.*"))

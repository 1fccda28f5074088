"""Token ids of a corpus in files of range-coded blocks, and what the files hold.

The documents are sorted by id into shards, one a task. A task strings the ids of its documents
together, an end id after each, and cuts the string into blocks for `rangecoder`, whatever documents they
hold. A row of a file is a block: its bytes (header, checksum, code), where it lies in its
shard, and which documents end in it. Any task can read any blocks; a document that several
blocks hold is put together from the checksums of its parts.
"""

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.llm import rangecoder
from claimloom.llm.worker import kept, portions
from claimloom.session import stored
from claimloom.sizing import broadcast_if_small

#: Bytes of text that a shard should hold; a task holds the memory of one batch of blocks, not of a shard.
SHARD_BYTES = 64 << 20
#: Bytes of texts that are cut at once, of pieces that the tokenizer gets at once, and of different pieces whose ids a worker keeps.
TEXTS, PIECES, KNOWN = 12 << 20, 128 << 10, 10 << 20
#: Pieces whose ids are put together at once.
TOGETHER = 1 << 17
#: First bytes of the characters of two and three bytes that may be blanks.
TWO, THREE = 0xC2, (0xE1, 0xE2, 0xE3)
#: ASCII letters, and the characters that no match holds behind a letter; an apostrophe may begin a match of its own with letters.
LETTERS = np.array([chr(k).isalpha() and k < 128 for k in range(256)])
MARKS = frozenset(b'\n!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')


class Pieces:
    """Ids of texts by the tokenizers library, each different piece encoded once as long as it is kept.

    The byte-level pattern always starts a new match at a blank that stands alone between two
    characters that are no blanks, and at a mark behind a letter, so a text may be cut there (`safe_cuts`, `mark_cuts`), and such pieces may be
    strung together anew: those that begin with a blank one after the other, those that begin with a mark behind a
    letter each. The first and the last piece of a text are encoded by themselves.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocab = max(names.values()) + 1
        self.width = np.zeros(self.vocab, np.int64)  # bytes of a token: a letter of its name is one, but for added tokens
        self.width[list(names.values())] = [len(name) for name in names]
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[number] = len(token.content.encode())
        added = b"".join(token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values())
        self.marks = bytes(k in MARKS and k not in added for k in range(256))  # an added token is never cut
        self.forget()

    def forget(self):
        """Pieces that are kept, and where their ids are in a row."""
        self.known, self.flat = pa.array([], pa.binary()), np.empty(0, np.int32)
        self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int32)

    def encoded(self, texts):
        """Ids of each text, in portions that bound the library's memory."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= PIECES):
                size += len(texts[end])
                end += 1
            for one in self.tokenizer.encode_batch_fast(texts[start:end], add_special_tokens=False):
                yield np.array(one.ids, np.int32)
            start = end

    def strung(self, pieces):
        """Ids of a binary array of inner pieces, in a row, and how many there are up to the end of each."""
        if not len(pieces):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
        data, places = pieces.buffers()[2].to_pybytes(), [0]
        while places[-1] < len(pieces):
            places.append(max(places[-1] + 1, int(np.searchsorted(ends, ends[places[-1]] + PIECES, "right")) - 1))
        ids = np.concatenate(list(self.encoded([data[ends[a]:ends[b]].decode() for a, b in zip(places, places[1:])])))
        upto = np.cumsum(self.width[ids])
        last = np.searchsorted(upto, ends[1:] - ends[0])
        if (upto[last] != ends[1:] - ends[0]).any():
            raise ValueError("the tokenizer joins letters across a single blank; its pattern is not the byte-level one")
        return ids, last + 1

    def learn(self, pieces):
        """Keeps the ids of new inner pieces, a binary array without repeats."""
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces)]
        blank = np.frombuffer(pieces.buffers()[2], np.uint8)[ends] == 32
        words, words_upto = self.strung(pieces.filter(pa.array(blank)))
        marked = pieces.filter(pa.array(~blank))
        turns = np.zeros(2 * len(marked), np.int64)
        turns[1::2] = np.arange(1, len(marked) + 1)
        marks, marks_upto = self.strung(pa.concat_arrays([pa.array([b" a"], pa.binary()), marked]).take(pa.array(turns)))
        upto, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        upto[blank], size[blank] = words_upto, np.diff(words_upto, prepend=0)
        upto[~blank], size[~blank] = len(words) + marks_upto[1::2], marks_upto[1::2] - marks_upto[::2]
        self.start = np.append(self.start, (len(self.flat) + upto - size).astype(np.int32))
        self.size = np.append(self.size, size.astype(np.int32))
        self.flat = np.concatenate([self.flat, words, marks])

    def numbers(self, pieces):
        """Which of the kept pieces the inner pieces are; new ones are kept."""
        if self.known.nbytes > KNOWN:
            self.forget()
        if not len(pieces):
            return np.empty(0, np.int32)
        found = pa.chunked_array([self.known, pieces]).dictionary_encode().chunks[-1]
        new = found.dictionary.slice(len(self.known))
        if len(new):
            self.learn(new)
            self.known = found.dictionary
        return found.indices.to_numpy()

    def ids(self, texts):
        """Ids of all texts (bytes), in a row, and the number of each text; bytes that are no UTF-8 are read as U+FFFD."""
        ends, data = np.cumsum([len(x) for x in texts], dtype=np.int64), b"".join(texts)
        if not data:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        try:
            data.decode()
        except UnicodeDecodeError:
            return self.ids([x.decode("utf-8", "replace").encode() for x in texts])
        bounds = np.unique(np.append(ends, 0))
        cuts = np.sort(np.concatenate([safe_cuts(np.frombuffer(data, np.uint8)), mark_cuts(data, self.marks), bounds]))
        cuts = cuts[np.append(True, cuts[1:] > cuts[:-1])]
        outer = np.zeros(len(cuts), bool)
        outer[np.searchsorted(cuts, bounds)] = True
        outer = outer[:-1] | outer[1:]
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data)])
        at = self.numbers(pieces.filter(pa.array(~outer)))
        edges = list(self.encoded([x.decode() for x in pieces.filter(pa.array(outer)).to_pylist()]))
        sizes, start = np.empty(len(pieces), np.int32), np.empty(len(pieces), np.int32)
        sizes[~outer], start[~outer] = self.size.take(at), self.start.take(at)
        sizes[outer] = [len(x) for x in edges]
        start[outer] = len(self.flat) + np.cumsum(sizes[outer]) - sizes[outer]
        flat, upto = np.concatenate([self.flat, *edges]), np.append(0, np.cumsum(sizes, dtype=np.int64))
        ids = np.empty(upto[-1], np.int32)
        for a in range(0, len(pieces), TOGETHER):
            b = min(a + TOGETHER, len(pieces))
            place = np.arange(upto[a], upto[b])
            place += np.repeat(start[a:b] - upto[a:b], sizes[a:b])
            flat.take(place, out=ids[upto[a]:upto[b]], mode="clip")
        return ids, np.diff(upto[np.searchsorted(cuts, ends)], prepend=0)


def mark_cuts(data, marks):
    """Places of marks (a table of 256 bytes) behind an ASCII letter."""
    at = np.flatnonzero(np.frombuffer(data.translate(marks), bool))
    at = at[at > 0]
    return at[LETTERS[np.frombuffer(data, np.uint8)[at - 1]]]


def safe_cuts(data):
    """Places of single blanks between two characters that are no blanks, in UTF-8."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 2) & (at < len(data) - 1)]
    after, before, second, third = data[at + 1], data[at - 1], data[at - 2], data[at - 3]
    blank = (after <= 32) | (before <= 32) | (after == TWO) | (second == TWO)
    return at[~(blank | np.isin(after, THREE) | np.isin(third, THREE))]


def _blocks_of(doc_id):
    return f"shard int, first long, size int, doc long, fresh boolean, ends array<struct<doc_id:{doc_id},upto:int>>, data binary"


def _arrow(spark, columns):
    """The Arrow schema of a list of columns in Spark's notation, and Spark's own."""
    empty = spark.createDataFrame([], columns)
    return empty.toArrow().schema, empty.schema


def _coded(batches, path, end, schema):
    """Rows of blocks of one shard from its documents in order."""
    own = kept(("pieces", path), lambda: Pieces(path))
    vocab, shard = max(own.vocab, end + 1), TaskContext.get().partitionId()
    held, ends, first, done = [np.empty(0, np.int32)], [], 0, 0  # ids and (doc_id, its end in the shard) not written, and what is
    total, batch_ids = 0, rangecoder.BLOCK * rangecoder.LANES

    def rows(ids):
        nonlocal ends, first, done
        blocks = rangecoder.pack(ids, vocab)
        starts = first + rangecoder.BLOCK * np.arange(len(blocks))
        sizes = np.minimum(first + len(ids) - starts, rangecoder.BLOCK)
        last = np.array([upto for _, upto in ends], np.int64)
        until = np.searchsorted(last, starts + sizes, "right")
        since = np.append(0, until[:-1])
        fresh = (starts == 0) | np.isin(starts, last) | (np.arange(len(blocks)) == 0) & rows.fresh
        rows.fresh = bool(until[-1]) and last[until[-1] - 1] == first + len(ids)
        lists = [[{"doc_id": d, "upto": upto - s} for d, upto in ends[a:b]] for a, b, s in zip(since.tolist(), until.tolist(), starts.tolist())]
        columns = [[shard] * len(blocks), starts, sizes, done + since, fresh, lists, blocks]
        first, done, ends = first + len(ids), done + int(until[-1]), ends[until[-1]:]
        for k in range(0, len(blocks), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c[k:k + 256], t) for c, t in zip(columns, schema.types)], schema=schema)

    rows.fresh = True
    for batch in portions(batches, "text", TEXTS):
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        ids, sizes = own.ids(texts)
        held.append(np.insert(ids, np.cumsum(sizes), end))
        for doc, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
            total += size + 1
            ends.append((doc, total))
        if total - first >= batch_ids:
            ids = np.concatenate(held)
            while len(ids) >= batch_ids:
                yield from rows(ids[:batch_ids])
                ids = ids[batch_ids:]
            held = [ids]
    if total > first:
        yield from rows(np.concatenate(held))


def write(docs, path, tokenizer, end=2, doc_id="doc_id", text="text", shards=None):
    """Writes the token ids of all texts of `docs`, `end` after each, in ascending doc_id order, to the folder `path`.

    `tokenizer`: path of a byte-level BPE file of the tokenizers library, the same on all executors;
    whole texts are encoded, without special tokens added. A null or empty text is the end id alone. Null ids come
    first, and rows with one id are in the order of their texts' digests; each row is a document, repeated rows too. Ids may be of any
    type that sorts. Only the named columns are read. An empty table gives files without rows.

    The folder holds Parquet files, so any of Spark's file systems can hold it, of rows (shard, first: place of the
    block in the shard's ids, size: its ids, doc: number of the shard's document it starts in, fresh: whether
    it starts with the first id of it, ends: documents that end in it, data: the block's bytes).
    Texts are sorted by range, once; a task holds one batch of blocks. `shards` is by default such that each has SHARD_BYTES.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if shards is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    order = ["doc_id", F.xxhash64("text")]
    placed = rows.repartitionByRange(int(shards), *order).sortWithinPartitions(*order)
    schema, own = _arrow(spark, _blocks_of(rows.schema["doc_id"].dataType.simpleString()))
    placed.mapInArrow(lambda batches: _coded(batches, tokenizer, end, schema), own).write.parquet(path)


def read(spark, path):
    """The blocks that `write` wrote."""
    return spark.read.parquet(path)


def parts(blocks, ids=False):
    """The parts of documents that each block holds, decoded.

    Columns: shard, doc (number in the shard), doc_id (null where the document goes on), ended, whole (whether it
    starts and ends in the block), at (place in the shard's ids), n, crc32 (of the ids as little-endian
    unsigned 32-bit numbers) and, with `ids`, the ids themselves. A damaged block is an error.
    """
    kind = blocks.schema["ends"].dataType.elementType["doc_id"].dataType.simpleString()
    listed = ", ids array<int>" if ids else ""
    schema, own = _arrow(blocks.sparkSession, f"shard int, doc long, doc_id {kind}, ended boolean, whole boolean, at long, n long, crc32 long{listed}")

    def run(batches):
        kept("tokenfile")
        for part in _gathered(batches):
            found = rangecoder.unpack([r["data"] for r in part])
            for k in range(0, len(part), 64):
                rows = [x for r, f in zip(part[k:k + 64], found[k:k + 64]) for x in _parts(r, f, ids)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return blocks.mapInArrow(run, own)


def _gathered(batches):
    """Rows in lists of as many as are decoded in step."""
    rows = []
    for batch in batches:
        rows += batch.to_pylist()
        while len(rows) >= rangecoder.LANES:
            yield rows[:rangecoder.LANES]
            rows = rows[rangecoder.LANES:]
    if rows:
        yield rows


def _parts(row, found, with_ids):
    """The parts of one block; the first may have begun in an earlier block, the last may go on in a later one."""
    start, doc = 0, row["doc"]
    ends = [(e["upto"], e["doc_id"], True) for e in row["ends"]]
    if not ends or ends[-1][0] < row["size"]:
        ends.append((row["size"], None, False))
    for upto, doc_id, ended in ends:
        ids = found[start:upto]
        out = {
            "shard": row["shard"], "doc": doc, "doc_id": doc_id, "ended": ended, "whole": ended and (start > 0 or row["fresh"]),
            "at": row["first"] + start, "n": len(ids), "crc32": zlib.crc32(ids.tobytes()),
        }
        if with_ids:
            out["ids"] = ids.astype(np.int32).tolist()
        yield out
        start, doc = upto, doc + 1


def documents(blocks):
    """What the blocks hold of each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    One row per document. All ids are decoded and every block's checksum is held against them. A document in one block
    is finished where it is decoded; of the others only places and checksums of their parts are shuffled.
    """
    found = stored(parts(blocks), "document-parts")
    totals = blocks.groupBy("shard").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row a shard
    base = stored(totals.select("shard", F.coalesce(before, F.lit(0)).alias("base")), "shards")
    part = F.struct("at", "n", "crc32")
    cut = found.filter("not whole").groupBy("shard", "doc").agg(
        F.max(F.struct("ended", "doc_id"))["doc_id"].alias("doc_id"), F.sort_array(F.collect_list(part)).alias("parts"))
    whole = found.filter("whole").select("shard", "doc_id", "at", "n", "crc32")
    kind = found.schema["doc_id"].dataType.simpleString()
    schema, own = _arrow(blocks.sparkSession, f"shard int, doc_id {kind}, at long, n long, crc32 long")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_joined(r) for r in batch.to_pylist()], schema)

    every = whole.union(cut.mapInArrow(run, own))
    placed = every.join(broadcast_if_small(base), "shard")
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))


def _joined(row):
    value, n = 0, 0
    for part in row["parts"]:
        value = rangecoder.crc32_joined(value, part["crc32"], 4 * part["n"])
        n += part["n"]
    return {"shard": row["shard"], "doc_id": row["doc_id"], "at": row["parts"][0]["at"], "n": n, "crc32": value}

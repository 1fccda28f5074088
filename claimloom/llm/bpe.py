"""Byte-level BPE by a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its byte, an inner node the least
below it, the leftmost among equals, so the root is the next merge. A merge changes
three leaves - the pair itself, the part that is gone and the live neighbour on the
left - each in logarithmic time, so a piece of n bytes takes n log n however long it is.
"""

import base64
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from claimloom.llm.spans import keyed
from claimloom.llm.worker import kept, portions
from claimloom.sizing import spread

#: Pieces that a worker remembers in each of two generations; a bound on memory only.
CACHED = 200_000
#: The leaf of a byte that starts no pair of a rank; beyond every rank times every length.
NO_PAIR = 1 << 62
#: Longer pieces are not remembered.
CACHED_LENGTH = 64

def load_ranks(path):
    """Token bytes → rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(piece, ranks):
    """Ids of one piece of bytes.

    A leaf is rank * n + place, so the least of a range is its leftmost pair of lowest rank.
    """
    n, get = len(piece), ranks.get
    if n < 2:
        return [ranks[piece]] if n else []
    leaves, none = 1 << (n - 2).bit_length(), NO_PAIR
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        if (rank := get(piece[i:i + 2])) is not None:
            tree[leaves + i] = rank * n + i
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = b if b < a else a
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (best := tree[1]) < none:
        left = best % n
        gone = after[left]
        after[left] = end = after[gone]
        before[end] = left
        rank = get(piece[left:after[end]]) if end < n else None
        changes = [(gone, none), (left, none if rank is None else rank * n + left)]
        if left:
            i = before[left]
            rank = get(piece[i:end])
            changes.append((i, none if rank is None else rank * n + i))
        for i, value in changes:
            node = leaves + i
            if node < len(tree):  # the last byte starts no pair
                tree[node] = value
                while node := node >> 1:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    if b < a:
                        a = b
                    if tree[node] == a:
                        break
                    tree[node] = a
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts, piece by piece; pieces seen lately are looked up."""

    def __init__(self, ranks, pattern):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.new, self.old = {}, {}

    def piece(self, text):
        """Ids of a piece as 32-bit numbers; of bytes, so that many of them cost little to keep."""
        found = self.old.get(text)
        if found is None:
            raw = text.encode()
            found = array("i", [self.ranks[raw]] if raw in self.ranks else merge(raw, self.ranks)).tobytes()
        if len(text) <= CACHED_LENGTH:
            if len(self.new) >= CACHED:
                self.old, self.new = self.new, {}
            self.new[text] = found
        return found

    def packed(self, text):
        """Ids of a text as 32-bit numbers."""
        return b"".join([self.new.get(piece) or self.piece(piece) for piece in self.pieces(text)])

    def encode(self, text):
        return array("i", self.packed(text)).tolist()


def _encoder(shared, pattern):
    """The worker's encoder for a vocabulary, kept from task to task."""
    return kept(("bpe", id(shared), pattern), lambda: Encoder(shared.value, pattern))


def _encoded(batches, own, text, into):
    for batch in batches:
        packed = [own.packed(x or "") for x in batch.column(text).to_pylist()]
        ends = np.cumsum([0, *map(len, packed)]) // 4
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, into])


def _decoded(batches, tokens, ids, into):
    token = tokens.__getitem__
    for batch in batches:
        lists = batch.column(ids)
        numbers, ends, null = lists.values.to_numpy(), lists.offsets.to_pylist(), lists.is_null().to_pylist()
        out = (None if no else b"".join(map(token, numbers[a:b].tolist())) for no, a, b in zip(null, ends, ends[1:]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, into])


def with_ids(rows, ranks, pattern, text="text", into="ids", decoded=None):
    """`rows` with the token ids of their texts in the column `into`; a null or empty text has none.

    Columns that are already named `into` or `decoded` are replaced, all others stay.

    `ranks`: token bytes → rank, with all 256 single bytes; a vocabulary, whose size
    does not depend on the data, sent once to each executor. `pattern` cuts the text
    into pieces that are merged apart. No string is a special token. With `decoded`, a column of that
    name holds what the ids decode to, in the same pass; a worker then keeps the pieces it has learned.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    rows = spread(rows.drop(into, decoded or into))

    def run(batches):
        own = _encoder(shared, pattern)
        batches = _encoded(portions(batches, text), own, text, into)
        return _decoded(batches, own.tokens, into, decoded) if decoded else batches

    kinds = rows.withColumn(into, F.array().cast("array<int>"))
    return rows.mapInArrow(run, (kinds.withColumn(decoded, F.lit(None).cast("binary")) if decoded else kinds).schema)


def encode(docs, ranks, pattern, doc_id="doc_id", text="text", decoded=None):
    """Token ids of every text: doc_id, version (digest of the text), text, ids; one row per row of `docs`.

    A null or empty text has no ids. A null doc_id keeps its row, repeated rows give equal
    rows. Whole texts are encoded, and pieces of any length. Only the named columns are
    read. An empty table gives an empty result. `with_ids` tells of the vocabulary and of `decoded`.
    """
    return with_ids(keyed(docs, doc_id, text), ranks, pattern, decoded=decoded)


def decode(encoded, ranks, ids="ids", into="decoded"):
    """`encoded` with the bytes of `ids` in the column `into`; null ids give null, an unknown id is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    encoded = encoded.drop(into)
    schema = encoded.withColumn(into, F.lit(None).cast("binary")).schema
    return encoded.mapInArrow(lambda batches: _decoded(batches, shared.value, ids, into), schema)

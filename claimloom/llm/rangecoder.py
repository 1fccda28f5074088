"""Adaptive context-mixing range coder for token ids, in blocks that know nothing of each other.

A block numbers its ids by first appearance. For each id three models give the chances of
eight kinds: the id that last followed the two before it (order 2), the id that last
followed the one before (order 1), an id seen before, by how early it appeared (five kinds),
or a new one. Order 2 and order 1 give them by how often their last predictions held, order 0 by
the kind before. The three are mixed by weights that follow which model has been right, the
mixture drives a range coder, and what the kind leaves open is coded evenly. The models learn from stretch to
stretch of a block; within one they stand still, so much of the work is done on whole stretches.

All blocks of a batch are coded in step, as lanes of arrays: a block is sequential, blocks are not.
Every sum is taken in a fixed order, so decoding repeats what encoding computed bit by bit.
"""

import struct
import zlib

import numpy as np

#: Ids of a block, and blocks that are coded in step.
BLOCK, LANES = 4096, 1024
#: Ids must be below this bound: kinds take 12 bits of the range and a new id the rest.
MAX_VOCAB = 1 << 20
#: Block header: magic, ids, their crc32 as unsigned 32-bit little-endian numbers, bound of the ids, 16-bit words that follow.
HEADER, MAGIC = struct.Struct("<4sIIII"), b"TIDB"

KINDS, HIT2, HIT1, NEW = 8, 0, 1, 7
#: The kinds of ids seen before: by the place of first appearance, from `START` on.
START = np.array([0, 0, 0, 16, 64, 256, 1024, 0], np.int64)
WIDTH = np.array([1, 1, 16, 48, 192, 768, BLOCK - 1024, 0], np.int64)
KIND = np.append(np.repeat(np.arange(2, 7), WIDTH[2:7]), NEW)
SCALE = 1 << 12
#: Ids between two steps of learning, and how much of what was counted stays.
STRETCH, KEEP = 256, np.float32(0.75)
#: What is added to each count, and the share of a weight that goes to all models alike, so that nothing gets impossible.
LEFT, FORGET = np.float32(0.4), 0.1
#: How often in a row a prediction held: not yet made, made, held.
TRUST = 3
CONTEXTS = 1 << 13
#: Sums of the shares below each kind; of whole numbers, so exact in any order.
BELOW = np.triu(np.ones((KINDS, KINDS + 1), np.float32), 1)
TOP, LEAST = np.uint64(1 << 48), np.uint64(1 << 32)
WORD, UNITS = np.uint64(16), np.uint64(12)


def numbered(ids):
    """Of blocks of ids (lanes, length): for each id the place of its first appearance among the block's different ids."""
    out = np.empty(ids.shape, np.int32)
    for start in range(0, len(ids), 64):
        part = ids[start:start + 64]
        if part.max() < 1 << 16:
            part = part.astype(np.uint16)  # sorted by counting
        rows = np.arange(len(part))[:, None]
        order = np.argsort(part, axis=1, kind="stable")
        ranked = part[rows, order]
        fresh = np.ones(part.shape, bool)
        fresh[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        first = np.zeros(part.shape, bool)
        first[rows, order] = fresh
        place = np.cumsum(first, axis=1) - 1
        last_fresh = np.maximum.accumulate(np.where(fresh, np.arange(part.shape[1]), 0), axis=1)
        out[start:start + 64][rows, order] = place[rows, order[rows, last_fresh]]
    return out


class Model:
    """The predictions of every lane, and what they learn. Arrays of a stretch are (step, lane)."""

    def __init__(self, lanes, vocab):
        self.lanes, self.lane, self.vocab = lanes, np.arange(lanes), np.broadcast_to(vocab, lanes)
        # The successors of two ids and of one: place * 4 + trust.
        self.next = np.zeros(lanes * (CONTEXTS + BLOCK + 1), np.uint16)
        self.home = self.lane * CONTEXTS, lanes * CONTEXTS + self.lane * (BLOCK + 1)
        # Rows of each lane's states of order 2, order 1 and order 0.
        self.first = 0, lanes * TRUST, 2 * lanes * TRUST
        self.counts = np.zeros((lanes * (2 * TRUST + KINDS), KINDS), np.float32)
        self.weights = np.full((3, lanes), 1 / 3, np.float32)
        self.mix()

    def mix(self):
        """Chances of each state, and bounds of the kinds, of SCALE, for each state of the three orders together."""
        some = self.counts + LEFT
        total = some[:, 0].copy()
        for k in range(1, KINDS):
            total += some[:, k]
        self.chances = some / total[:, None]
        two, one, none = (self.chances[a:b].reshape(self.lanes, -1, KINDS) for a, b in zip(self.first, (*self.first[1:], len(some))))
        weight = [w[:, None, None] for w in self.weights]
        both = (two * weight[0])[:, :, None] + (one * weight[1])[:, None]
        mixed = both[:, :, :, None] + (none * weight[2])[:, None, None]
        mixed *= np.float32(SCALE - 2 * KINDS)
        np.floor(mixed, out=mixed)
        mixed += np.float32(1)
        self.bounds = (mixed.reshape(-1, KINDS) @ BELOW).astype(np.int32)

    def guess(self, before, last):
        """Where the predictions of the next id are kept, and what they are: order 2 and order 1."""
        at = self.home[0] + ((before * 40503 + last * 2741) & (CONTEXTS - 1)), self.home[1] + last
        return at, [self.next.take(x).astype(np.int64) for x in at]

    def row(self, guess, kind):
        """Row of `bounds` for the predictions and the kind before."""
        return ((self.lane * TRUST + (guess[0] & 3)) * TRUST + (guess[1] & 3)) * KINDS + kind

    def rest(self, kind, seen):
        """How many ids the kind leaves open when so many different ones are known."""
        width = np.minimum(WIDTH.take(kind), np.maximum(seen - START.take(kind), 1))
        return np.where(kind == NEW, self.vocab, width)

    def learn(self, at, guess, before, place, kind):
        """Takes in a stretch: the predictions, the kind before, the place and the kind of each of its ids."""
        rows = [self.lane * TRUST + (guess[0] & 3), self.first[1] + self.lane * TRUST + (guess[1] & 3), self.first[2] + self.lane * KINDS + before]
        share = [w * self.chances.reshape(-1).take(row * KINDS + kind) for w, row in zip(self.weights, rows)]
        total = share[0] + share[1]
        total += share[2]
        for j in range(3):
            held = (share[j] / total).sum(0) / np.float32(len(kind))
            self.weights[j] = held * np.float32(1 - FORGET) + np.float32(FORGET / 3)
        more = np.zeros(self.counts.size, np.int64)
        for row in rows:
            more += np.bincount((row * KINDS + kind).reshape(-1), minlength=more.size)
        self.counts = self.counts * KEEP + more.reshape(self.counts.shape).astype(np.float32)
        for where, what in zip(at, guess):
            trust = np.where((what >> 2 == place) & (what & 3 > 0), 2, 1)
            self.next[where.reshape(-1)] = (place * 4 + trust).astype(np.uint16).reshape(-1)  # the last of a place stays
        self.mix()


class Range:
    """Low ends and widths of the lanes' ranges, narrowed by a kind and by what it leaves open; a carry never happens."""

    def __init__(self, lanes):
        self.low, self.width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)

    def settled(self, at=None):
        """The lanes, of `at` if given, whose next 16 bits are settled, and their low ends before these are shifted out; None if there is none.

        A lane of TOP or wider has none, and only one that had some just now can have more before the next id.
        """
        if at is None:
            at = np.flatnonzero(self.width < TOP)
        low, width = self.low[at], self.width[at]
        same = (low ^ (low + width)) < TOP
        some = np.flatnonzero(same | (width < LEAST))
        if not len(some):
            return None
        if len(some) < len(at):
            at, low, width, same = at[some], low[some], width[some], same[some]
        if not same.all():
            width = np.where(same, width, (~low + np.uint64(1)) & (LEAST - np.uint64(1)))
        self.low[at], self.width[at] = low << WORD, width << WORD
        return at, low


def encode(ids, vocab):
    """The 16-bit words of each block of `ids` (lanes, length), as bytes."""
    lanes, length = ids.shape
    places = np.ascontiguousarray(numbered(ids).T)
    numbers = np.ascontiguousarray(ids.T)
    model, coder = Model(lanes, vocab), Range(lanes)
    out, used = np.zeros((lanes, 2 * length + 8), np.uint16), np.zeros(lanes, np.int64)
    flat, base = out.reshape(-1), np.arange(lanes) * out.shape[1]
    # One and two ids before the stretch as place + 1, the kind before it, and how many different ids are known.
    last, before, kind_before, known = (np.zeros(lanes, np.int64) for _ in range(4))
    for start in range(0, length, STRETCH):
        place = places[start:start + STRETCH].astype(np.int64)
        steps = len(place)
        one = np.concatenate([last[None], place[:-1] + 1])
        two = np.concatenate([before[None], one[:-1]])
        seen = np.maximum.accumulate(np.concatenate([known[None], place + 1]), axis=0)
        at, guess = model.guess(two, one)
        kind = KIND.take(place)
        kind[place == seen[:-1]] = NEW
        for hit, what in ((HIT1, guess[1]), (HIT2, guess[0])):
            kind[(what >> 2 == place) & (what & 3 > 0)] = hit
        earlier = np.concatenate([kind_before[None], kind[:-1]])
        cell = model.row(guess, earlier) * (KINDS + 1) + kind
        low = model.bounds.take(cell)
        size = (model.bounds.take(cell + 1) - low).astype(np.uint64)
        low = low.astype(np.uint64)
        left = np.where(kind == NEW, numbers[start:start + STRETCH], np.where(kind < 2, 0, place - START.take(kind))).astype(np.uint64)
        rest = model.rest(kind, seen[:-1]).astype(np.uint64)
        for step in range(steps):
            unit = coder.width >> UNITS
            wide = size[step] * unit
            wide //= rest[step]
            unit *= low[step]
            unit += left[step] * wide
            coder.low += unit
            coder.width = wide
            lane = None
            while (done := coder.settled(lane)) is not None:
                lane, word = done
                flat[base[lane] + used[lane]] = word >> np.uint64(48)
                used[lane] += 1
        model.learn(at, guess, earlier, place, kind)
        last, before, kind_before, known = place[-1] + 1, one[-1], kind[-1], seen[-1]
    for shift in (48, 32, 16, 0):
        flat[base + used] = (coder.low >> np.uint64(shift)) & np.uint64(0xFFFF)
        used += 1
    return [row[:n].astype("<u2").tobytes() for row, n in zip(out, used.tolist())]


def decode(words, length, vocab):
    """`length` ids of each lane from its words."""
    lanes = len(words)
    sizes = np.array([len(w) // 2 for w in words])
    stream = np.zeros((lanes, sizes.max() + 8), np.uint16)
    for row, w in zip(stream, words):
        row[:len(w) // 2] = np.frombuffer(w, "<u2")
    flat, base, read = stream.reshape(-1), np.arange(lanes) * stream.shape[1], np.full(lanes, 4, np.int64)
    limit = stream.shape[1] - 1
    code = np.zeros(lanes, np.uint64)
    for k in range(4):
        code = (code << WORD) | stream[:, k].astype(np.uint64)
    model, coder = Model(lanes, vocab), Range(lanes)
    names, home = np.zeros(lanes * (BLOCK + 1), np.int32), model.lane * (BLOCK + 1)
    out = np.empty((length, lanes), np.int32)
    last, before, kind, seen = (np.zeros(lanes, np.int64) for _ in range(4))
    for start in range(0, length, STRETCH):
        steps = min(STRETCH, length - start)
        ats, guesses = np.empty((2, steps, lanes), np.int64), np.empty((2, steps, lanes), np.int64)
        earlier, places, kinds = (np.empty((steps, lanes), np.int64) for _ in range(3))
        for step in range(steps):
            at, guess = model.guess(before, last)
            ats[0, step], ats[1, step] = at
            guesses[0, step], guesses[1, step] = guess
            earlier[step] = kind
            row = model.row(guess, kind)
            unit = coder.width >> UNITS
            value = ((code - coder.low) // unit).astype(np.int32)
            kind = (model.bounds.take(row, axis=0)[:, 1:KINDS] <= value[:, None]).sum(1)
            cell = row * (KINDS + 1) + kind
            low = model.bounds.take(cell)
            wide = (model.bounds.take(cell + 1) - low).astype(np.uint64) * unit
            coder.low += low.astype(np.uint64) * unit
            rest = model.rest(kind, seen)
            wide //= rest.astype(np.uint64)
            left = np.minimum(((code - coder.low) // wide).astype(np.int64), rest - 1)
            coder.low += left.astype(np.uint64) * wide
            coder.width = wide
            new = kind == NEW
            place = np.where(new, seen, START.take(kind) + left)
            for hit, what in ((HIT1, guess[1]), (HIT2, guess[0])):
                mine = kind == hit
                place[mine] = what[mine] >> 2
            place = np.minimum(place, BLOCK)
            fresh = np.flatnonzero(new)
            names[home[fresh] + place[fresh]] = left[fresh]
            out[start + step] = names.take(home + place)
            lane = None
            while (done := coder.settled(lane)) is not None:
                lane = done[0]
                code[lane] = (code[lane] << WORD) | flat[base[lane] + np.minimum(read[lane], limit)]
                read[lane] += 1
            places[step], kinds[step] = place, kind
            seen = seen + new
            before, last = last, np.minimum(place + 1, BLOCK)
        model.learn(ats, guesses, earlier, places, kinds)
    return np.ascontiguousarray(out.T)


def pack(ids, vocab):
    """Blocks of up to BLOCK ids, in order, as bytes that tell their own length and checksum; `ids` is one sequence.

    The last block is filled up with its own last id to the length of the others in its batch; its header
    tells how many are meant.
    """
    if not 0 < vocab <= MAX_VOCAB:
        raise ValueError(f"ids must be below {MAX_VOCAB}")
    if len(ids) and not 0 <= ids.min() <= ids.max() < vocab:
        raise ValueError(f"an id is not below {vocab}")
    out = []
    for start in range(0, len(ids), BLOCK * LANES):
        part = ids[start:start + BLOCK * LANES]
        length = min(len(part), BLOCK)
        lanes = -(-len(part) // length)
        filled = np.concatenate([part, np.full(lanes * length - len(part), part[-1], part.dtype)]).reshape(lanes, length)
        for k, words in enumerate(encode(filled, vocab)):
            block = part[k * length:(k + 1) * length]
            out.append(HEADER.pack(MAGIC, len(block), zlib.crc32(block.astype("<u4").tobytes()), vocab, len(words) // 2) + words)
    return out


def unpack(blocks):
    """The ids of each block (bytes that `pack` made), as unsigned 32-bit numbers; a block that is damaged is an error.

    Blocks may come from any files and in any order.
    """
    out = []
    for start in range(0, len(blocks), LANES):
        part = blocks[start:start + LANES]
        heads = [HEADER.unpack_from(b) if len(b) >= HEADER.size else (b"",) * 5 for b in part]
        bad = [k for k, (b, h) in enumerate(zip(part, heads)) if h[0] != MAGIC or not 0 < h[1] <= BLOCK or not 0 < h[3] <= MAX_VOCAB or len(b) != HEADER.size + 2 * h[4]]
        if bad:
            raise ValueError(f"block {start + bad[0]} of the batch is cut off or not a block")
        found = decode([b[HEADER.size:] for b in part], max(h[1] for h in heads), np.array([h[3] for h in heads]))
        for k, (row, head) in enumerate(zip(found, heads)):
            ids = row[:head[1]].astype("<u4")
            if zlib.crc32(ids.tobytes()) != head[2]:
                raise ValueError(f"the checksum of block {start + k} of the batch does not hold")
            out.append(ids)
    return out


def _times(matrix, vector):
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
        if not vector:
            return out
    return out


def _zeros():
    """Matrices over two values that take a crc32 past 1, 2, 4 .. zero bytes."""
    step = [0xEDB88320] + [1 << k for k in range(31)]  # one bit; the number is that of crc32
    for _ in range(3):
        step = [_times(step, row) for row in step]
    while True:
        yield step
        step = [_times(step, row) for row in step]


_POWERS, _NEXT = [], _zeros()


def crc32_joined(a, b, size):
    """crc32 of two byte strings after one another, from both and the size of the second."""
    k = 0
    while size:
        if k == len(_POWERS):
            _POWERS.append(next(_NEXT))
        if size & 1:
            a = _times(_POWERS[k], a)
        size >>= 1
        k += 1
    return a ^ b

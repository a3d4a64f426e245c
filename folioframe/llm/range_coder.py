"""Adaptive context-mixing range coder for token ids, many blocks side by side.

Each block starts from an unlearned model and ends with its own checksum, so it can be read alone. An id is one event
of a range coder: the order-2 prediction is right, or the order-1 prediction is, or the id comes from order 0, whose
odds are the file's own counts. How likely each order is to be right is mixed, id by id, from what its own trust and
both orders' trusts have earned so far in the block, by learned weights. All arithmetic is on integers, so encoder and
decoder agree on every machine. Blocks are lanes of numpy arrays: one step codes one id of every block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, PAIR = b"TOKR2\n", b"TOKR2+"
#: Different ids that one table of odds can hold.
MAX_IDS = (1 << 17) - 1
#: The coder's state has 48 bits and moves by words of 16.
TOP, BOT, MASK, WORD = np.uint64(1 << 32), np.uint64(1 << 30), np.uint64((1 << 48) - 1), np.uint64(16)
#: Bits of the odds between orders, and bits that choose a context's cell.
ODDS, HASH_BITS = 12, 10
#: Ids per block, between these; larger inputs have larger blocks, at most MAX_LANES of which are coded at once.
MIN_BLOCK, MAX_BLOCK, MAX_LANES = 512, 16384, 2048


class _Coder:
    """Carry-less range coder states of all lanes."""

    def __init__(self, lanes: int, room: int, words: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, MASK)
        self.decoding = words is not None
        if self.decoding:
            self.words, self.at, self.code = words, starts.copy(), np.zeros(lanes, np.uint64)
            for _ in range(3):
                self.code = (self.code << WORD) & MASK | words[self.at].astype(np.uint64)
                self.at += 1
        else:
            self.room = room
            self.words, self.at = np.zeros(lanes * room, np.uint16), np.arange(lanes) * room
            self.first = self.at.copy()

    def split(self, bits: int) -> np.ndarray:
        self.step = self.range >> np.uint64(bits)
        return self.step

    def target(self) -> np.ndarray:
        return ((self.code - self.low) // self.step).astype(np.int64)

    def apply(self, below: np.ndarray, size: np.ndarray) -> None:
        self.low += self.step * below
        self.range = self.step * size
        lanes = np.flatnonzero((self.low ^ (self.low + self.range)) < TOP) if self.range.min() >= BOT else np.flatnonzero(((self.low ^ (self.low + self.range)) < TOP) | (self.range < BOT))
        while len(lanes):
            low, rng = self.low[lanes], self.range[lanes]
            cut = (low ^ (low + rng)) >= TOP
            if cut.any():
                rng = np.where(cut, (~low + np.uint64(1)) & (BOT - np.uint64(1)), rng)
            self.shift(lanes, low)
            low, rng = (low << WORD) & MASK, rng << WORD
            self.low[lanes], self.range[lanes] = low, rng
            lanes = lanes[((low ^ (low + rng)) < TOP) | (rng < BOT)]

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.at[lanes]
        if self.decoding:
            self.code[lanes] = ((self.code[lanes] << WORD) & MASK) | self.words[at].astype(np.uint64)
        else:
            self.words[at] = (low >> np.uint64(32)).astype(np.uint16)
        self.at[lanes] = at + 1

    def widen(self) -> None:
        """Room for twice the words once a lane has used three quarters."""
        if (self.at - self.first).max() > self.room * 3 // 4:
            used, lanes = self.at - self.first, len(self.at)
            self.words = np.concatenate([self.words.reshape(lanes, -1), np.zeros((lanes, self.room), np.uint16)], 1).ravel()
            self.room *= 2
            self.first = np.arange(lanes) * self.room
            self.at = self.first + used

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(3):
            self.shift(every, self.low)
            self.low = (self.low << WORD) & MASK
        return [self.words[a:z].astype("<u2").tobytes() for a, z in zip(self.first.tolist(), self.at.tolist(), strict=True)]


class Counts:
    """Order 0: odds out of 2^bits of every rank, from the file's counts; each at least 1."""

    def __init__(self, count: np.ndarray):
        self.bits = max(16, len(count).bit_length() + 1)
        if self.bits + ODDS > 30:
            raise ValueError("more different ids than the coder's precision allows (131,072)")
        whole = 1 << self.bits
        size = 1 + count.astype(np.int64) * (whole - len(count)) // max(1, int(count.sum()))
        if len(size):
            size[0] += whole - size.sum()
        self.size, self.below = size, np.cumsum(size) - size
        self.rank = np.repeat(np.arange(len(size), dtype=np.int32), size)


class _Model:
    """Contexts of all lanes, order 1 in row 0 and order 2 in row 1 of every array. A cell holds a guess (a rank) and
    the trust it has earned, 0 (no guess) to 7. Places are flat and of numpy's own index type: storing by others takes twice as long."""

    def __init__(self, lanes: int, counts: Counts):
        self.counts = counts
        lane = np.arange(2 * lanes, dtype=np.intp).reshape(2, lanes)
        self.base, self.by8, self.by64 = lane << HASH_BITS, lane << 3, lane << 6
        self.cells = np.zeros(2 * lanes << HASH_BITS, np.int32)
        self.own, self.both = np.full(2 * lanes << 3, 1024, np.int32), np.full(2 * lanes << 6, 1024, np.int32)
        self.weight = np.full((2, lanes), 128 << 8, np.int32)
        self.one = self.two = np.zeros(lanes, np.uint32)
        self.at = np.empty((2, lanes), np.intp)

    def step(self, coder: _Coder, x: np.ndarray | None) -> np.ndarray:
        """Codes the next rank of every lane, or reads it if x is None."""
        order0, bits, at = self.counts, self.counts.bits, self.at
        shift = np.uint32(32 - HASH_BITS)
        at[0] = self.one * np.uint32(0x9E3779B1) >> shift
        at[1] = self.one * np.uint32(0x85EBCA6B) + self.two * np.uint32(0xC2B2AE35) >> shift
        at += self.base
        cell = self.cells.take(at)
        trust, guess = cell & 7, cell >> 3
        place = trust.astype(np.intp)
        own_at, both_at = self.by8 + place, self.by64 + ((place[1] << 3) + place[0])
        own, both = self.own.take(own_at), self.both.take(both_at)
        apart = own - both
        odds = both + ((self.weight >> 8) * apart >> 8)
        asked = trust > 0
        asked[0] &= ~asked[1] | (guess[0] != guess[1])
        two = odds[1] * asked[1]
        one = np.maximum((4096 - two) * odds[0] >> ODDS, 1) * asked[0]
        both_odds = two + one
        rest = 4096 - both_odds
        coder.split(ODDS + bits)
        right = np.empty(asked.shape, bool)
        if x is None:
            t = coder.target()
            q = t >> bits
            right[1] = q < two
            right[0] = ~right[1] & (q < both_odds)
            inner = np.minimum(np.maximum(t - (both_odds.astype(np.int64) << bits), 0) // rest, (1 << bits) - 1)
            x = np.where(right[1], guess[1], np.where(right[0], guess[0], order0.rank.take(inner)))
        else:
            right[1] = asked[1] & (guess[1] == x)
            right[0] = asked[0] & ~right[1] & (guess[0] == x)
        miss = ~(right[1] | right[0])
        from_0 = (rest * miss).astype(np.int64)
        below = ((two * right[0] + both_odds * miss).astype(np.int64) << bits) + from_0 * order0.below.take(x)
        size = ((two * right[1] + one * right[0]).astype(np.int64) << bits) + from_0 * order0.size.take(x)
        coder.apply(below.view(np.uint64), size.view(np.uint64))
        # learn: each order's odds and weight where it was asked, then the contexts' guesses
        asked[0] &= ~right[1]
        asked = asked.astype(np.int32)
        goal = right * np.int32(4095)
        self.weight = np.minimum(np.maximum(self.weight + ((goal - odds) * apart >> 10) * asked, 0), 255 << 8)
        # steps of 1/16; towards 4095 they end at 4080 by themselves
        self.own[own_at.ravel()] = np.maximum(own + ((goal - own) * asked >> 4), 16).ravel()
        self.both[both_at.ravel()] = np.maximum(both + ((goal - both) * asked >> 4), 16).ravel()
        same = (guess == x) & (trust > 0)
        kept = np.where(same, cell + (trust < 7), cell - (trust + 1 >> 1))
        self.cells[at.ravel()] = np.where(same | (trust > 1), kept, (x << 3 | 1).astype(np.int32)).ravel()
        self.two, self.one = self.one, (x + 1).astype(np.uint32)
        return x


def block_length(n: int) -> int:
    """Of a stream that needs no more than MAX_LANES blocks, about as long as fills all lanes; a step costs the same."""
    return min(MAX_BLOCK, max(MIN_BLOCK, -(-n // (64 * MAX_LANES)) * 64))


def encode_ids(ids: np.ndarray, max_ids: int = MAX_IDS) -> bytes:
    """A self-contained stream: ids by falling frequency, then blocks, each with its length and CRC-32.

    Of more different ids than one table of odds can hold, each half becomes a stream of its own.
    """
    ids = np.asarray(ids, np.uint32)
    count = np.bincount(ids)
    names = np.flatnonzero(count)
    if len(names) > max_ids:
        halves = [encode_ids(x, max_ids) for x in np.array_split(ids, 2)]
        return PAIR + struct.pack("<Q", len(halves[0])) + b"".join(halves)
    order = np.lexsort((names, -count[names]))
    place = np.zeros(len(count), np.int64)
    place[names[order]] = np.arange(len(names))
    rank, count = place[ids], count[names]
    length = block_length(len(ids))
    blocks = -(-len(ids) // length)
    padded = np.zeros(blocks * length, np.int32)
    padded[: len(ids)] = rank
    lanes = padded.reshape(blocks, length)
    counts = Counts(count[order])
    body = []
    for a in range(0, blocks, MAX_LANES):
        part = np.ascontiguousarray(lanes[a : a + MAX_LANES].T)
        coder, model = _Coder(part.shape[1], length + 64), _Model(part.shape[1], counts)
        for t, x in enumerate(part):
            model.step(coder, x)
            if t % 32 == 0:
                coder.widen()
        body += coder.finish()
    sums = [zlib.crc32(ids[i * length : (i + 1) * length].astype("<u4").tobytes()) for i in range(blocks)]
    table = zlib.compress(np.stack([names[order], count[order]]).astype("<u4").tobytes())
    head = struct.pack("<QIIII", len(ids), length, blocks, len(names), len(table)) + table
    index = np.array([[len(b), s] for b, s in zip(body, sums, strict=True)], "<u4").reshape(-1, 2).tobytes()
    return MAGIC + head + index + b"".join(body)


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of a stream; ValueError if it is cut short or a block does not have its checksum."""
    try:
        if data[: len(PAIR)] == PAIR:
            at = len(PAIR) + 8
            mid = at + struct.unpack_from("<Q", data, len(PAIR))[0]
            return np.concatenate([decode_ids(data[at:mid]), decode_ids(data[mid:])])
        return _decode(data)
    except (IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
        raise ValueError("damaged token stream") from e


def _decode(data: bytes) -> np.ndarray:
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token stream")
    at = len(MAGIC)
    n, length, blocks, size, packed = struct.unpack_from("<QIIII", data, at)
    at += struct.calcsize("<QIIII")
    names, count = np.frombuffer(zlib.decompress(data[at : at + packed]), "<u4").reshape(2, size)
    counts = Counts(count)
    at += packed
    index = np.frombuffer(data, "<u4", 2 * blocks, at).reshape(-1, 2)
    at += 8 * blocks
    words = np.concatenate([np.frombuffer(data[at:], "<u2"), np.zeros(8, np.uint16)])
    starts = np.concatenate([[0], np.cumsum(index[:, 0].astype(np.int64) // 2)])
    out = np.zeros((blocks, length), np.int32)
    for a in range(0, blocks, MAX_LANES):
        z = min(blocks, a + MAX_LANES)
        coder, model = _Coder(z - a, 0, words, starts[a:z]), _Model(z - a, counts)
        part = np.zeros((length, z - a), np.int32)
        for t in range(length):
            part[t] = model.step(coder, None)
        out[a:z] = part.T
    flat = out.ravel()[:n]
    ids = names[flat].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for i in range(blocks):
        if zlib.crc32(ids[i * length : (i + 1) * length].astype("<u4").tobytes()) != int(index[i, 1]):
            raise ValueError(f"block {i} is damaged")
    return ids

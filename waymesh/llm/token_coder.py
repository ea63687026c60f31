"""An adaptive context-mixing range coder for token ids, in numpy.

Ids are coded in blocks that know nothing of each other: each starts with a fresh model and has a checksum. A block
begins with its different ids in order, and a model predicts which of them comes next three times. Order 0 is how often
each comes where the other two fail; it stands in front of the block. Orders 1 and 2 remember which id came after the
last one or two ids, and how much that is to be trusted. The three are mixed, by weights that follow how often guesses of
that trust were right, into one distribution over the block's ids, which drives the range coder.

Blocks are independent, so many are coded in step: arrays hold a lane for each block, and a step codes one id of each.
All arithmetic is on integers, so that every machine decodes what another has coded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np

BLOCK = 4096  # ids in a block, at most
LANES = 2048
LEAST_BLOCK = 1024  # ids in a block where there are too few to fill all lanes

_BITS = 12  # of order 0 as of a weight; BLOCK ids can all differ
_ONE = 1 << _BITS
_TOTAL = np.uint64(2 * _BITS)
_LAST = np.uint64((1 << 2 * _BITS) - 1)
_SLOTS = 1 << 10  # pairs of ids that order 2 remembers, for a block
_TRUST = 2  # bits of it; 0: nothing is remembered
_MOST = (1 << _TRUST) - 1
_CELLS = 1 << (2 * _TRUST + 1)  # of weights, by the trust in both guesses and whether they are the same
_CERTAIN = _ONE - 16  # the most weight a guess gets
_LEARN = 5
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77], np.uint32)
_SHIFT = np.uint32(32 - 10)  # a hash becomes a slot

# The coder: 62 bits of a number, of which 32 at a time leave at the top.
_FULL = np.uint64((1 << 62) - 1)
_LOW = np.uint64(1 << 30)
_TOP, _KEEP, _WORD = np.uint64(30), np.uint64((1 << 30) - 1), np.uint64(32)
_TWO, _THREE = np.uint64(2), np.uint64(3)

_HEAD = struct.Struct("<IIBII")  # ids, 16-bit words, digits, CRC-32 of the ids, CRC-32 of all that is stored
_TABLE = struct.Struct("<HH")  # different ids (0: the ids follow as they are), rows of order 0


def digits_for(vocabulary: int) -> int:
    """Hexadecimal digits of the ids below vocabulary."""
    return max(1, -(-max(1, (vocabulary - 1).bit_length()) // 4))


def _plain(digits: int) -> str:
    return "<u2" if digits <= 4 else "<u4"


class _Guesses:
    """What orders 1 and 2 remember, in lanes: an id's place among the block's ids, and the trust in it. Lanes that are
    done are always the last ones."""

    def __init__(self, lanes: int, most: int):
        """most: of different ids in a block."""
        lane = np.arange(lanes) * (most + _SLOTS)
        self.starts = np.stack([lane, lane + most])
        self.held = np.zeros(lanes * (most + _SLOTS), np.int16)
        self.slot, self.before = self.starts.copy(), np.zeros(lanes, np.uint32)

    def of(self, n: int) -> np.ndarray:
        """(order, lane), for the next ids of n lanes."""
        self.slot = self.slot[:, :n]
        self.now = self.held.take(self.slot)
        return self.now

    def learn(self, ids: np.ndarray, right: np.ndarray) -> None:
        """ids came; right (order, lane): whether they had been guessed."""
        now, n = self.now, len(ids)
        trust = now & _MOST
        lost = now - (trust >> 1)
        lost += ((ids << _TRUST) + 1 - lost) * (trust < 2)
        lost += (now + (trust < _MOST) - lost) * right
        self.held[self.slot] = lost
        wide = ids.astype(np.uint32)
        np.add(self.starts[0, :n], ids, out=self.slot[0])
        np.add(self.starts[1, :n], (wide * _FACTORS[0] + self.before[:n]) >> _SHIFT, out=self.slot[1])
        self.before = wide * _FACTORS[1]


class _Mixer:
    """Mixes what the orders say. The weights of guesses follow how often such guesses were right."""

    def __init__(self, counts: np.ndarray):
        """counts (lane, place): order 0."""
        lanes, most = counts.shape
        ends = np.cumsum(counts, axis=1)
        ends = (ends << _BITS) // ends[:, -1:]  # no count becomes nothing
        self.sizes = np.diff(ends, axis=1, prepend=0)
        self.order0 = ((ends - self.sizes) << (_BITS + 1) | self.sizes).astype(np.int32).ravel()
        self.lane0 = np.arange(lanes) * most
        trust = np.arange(_CELLS) >> 1
        start = np.array([_CERTAIN * t // (t + 2) for t in range(_MOST + 1)])
        self.weights = np.tile(start.take(trust >> _TRUST) << 16 | start.take(trust & _MOST), lanes).astype(np.int32)
        self.lane = np.arange(lanes) * _CELLS

    def weigh(self, guesses: np.ndarray) -> None:
        """Takes the guesses (order, lane) for the next ids: their ids and weights, and that of order 0."""
        n = guesses.shape[1]
        trust, self.ids = guesses & _MOST, guesses >> _TRUST
        differ = self.ids[0] != self.ids[1]
        self.cell = self.lane[:n] + ((trust[1] << (_TRUST + 1)) + (trust[0] << 1) + differ)
        both = self.weights.take(self.cell)
        self.one, self.second = both & 0xFFFF, both >> 16
        self.first = ((_ONE - self.second) * self.one >> _BITS) * differ
        self.zero = _ONE - self.first - self.second

    def found(self, whole: np.ndarray, inverse: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """The ids whose parts of the distribution hold the numbers whole. What the guesses add is taken out, order 2's
        first; what is left is of order 0."""
        ids, n = self.ids, len(whole)
        starts = (self.order0.take(self.lane0[:n] + ids) >> (_BITS + 1)) * self.zero
        first, second = self.first << _BITS, self.second << _BITS
        whole = whole - np.minimum(np.maximum(whole - starts[1] - first * (ids[0] < ids[1]), 0), second)
        whole -= np.minimum(np.maximum(whole - starts[0], 0), first)
        return inverse.take(lane + whole // self.zero)

    def part(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of ids begin, and how large they are. Then learns them."""
        both = self.order0.take(self.lane0[: len(ids)] + ids)
        self.right, less = self.ids == ids, self.ids < ids
        hits = self.first * self.right[0] + self.second * self.right[1]
        start = self.zero * (both >> (_BITS + 1)) + ((self.first * less[0] + self.second * less[1]) << _BITS)
        size = self.zero * (both & (2 * _ONE - 1)) + (hits << _BITS)
        one, two = self.right[0] * np.int32(_CERTAIN), self.right[1] * np.int32(_CERTAIN)
        one = self.one + ((one - self.one) >> _LEARN) * ~self.right[1]
        two = self.second + ((two - self.second) >> _LEARN)
        self.weights[self.cell] = (two << 16) + one
        return start.astype(np.uint64), size.astype(np.uint64)


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose, copied by pieces that stay in the cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for a in range(0, len(rows), 64):
        for b in range(0, rows.shape[1], 256):
            out[b : b + 256, a : a + 64] = rows[a : a + 64, b : b + 256].T
    return out


def _places(block: np.ndarray, digits: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's different ids in order, and the place of each of its ids among them. place: room for 2**16 places."""
    if digits > 4:
        return np.unique(block, return_inverse=True)
    ids = np.sort(block.astype(np.uint32))
    new = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:])
    ids = ids[new]
    place[ids] = np.arange(len(ids))
    return ids, place.take(block)


def _low_bits(m: int, digits: int) -> int:
    return ((1 << 4 * digits) // m).bit_length() - 1


def _table(ids: np.ndarray, counts: np.ndarray, digits: int) -> bytes:
    """Different ids in order and the count of each: low bits of the ids, what is above them in unary, counts in unary."""
    m, bits = len(ids), _low_bits(len(ids), digits)
    low = (ids.astype(np.uint32) >> np.arange(bits, dtype=np.uint32)[:, None]) & np.uint32(1)
    high = np.zeros(m + (1 << 4 * digits - bits), np.uint8)
    high[(ids.astype(np.int64) >> bits) + np.arange(m)] = 1
    starts = np.cumsum(counts) - counts
    total = int(starts[-1] + counts[-1])
    each = np.zeros(total, np.uint8)
    each[starts] = 1
    return _TABLE.pack(m, total) + b"".join(np.packbits(b.astype(np.uint8), axis=None).tobytes() for b in (low, high, each))


def _read_table(data: bytes, digits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ids and counts of a block's table, and how many bytes it has."""
    m, total = _TABLE.unpack_from(data)
    bits, at = _low_bits(m, digits), _TABLE.size

    def take(n: int) -> np.ndarray:
        nonlocal at
        a, at = at, at + -(-n // 8)
        return np.unpackbits(np.frombuffer(data, np.uint8, at - a, a))[:n]

    low = (take(m * bits).reshape(bits, m).astype(np.uint32) << np.arange(bits, dtype=np.uint32)[:, None]).sum(axis=0, dtype=np.int64)
    high = np.flatnonzero(take(m + (1 << 4 * digits - bits)).view(bool)) - np.arange(m)
    ends = np.full(m, total)
    starts = np.flatnonzero(take(total).view(bool))
    ends[:-1] = starts[1:]
    return high << bits | low, ends - starts, at


def _encode_lanes(blocks: Sequence[np.ndarray], digits: int) -> list[bytes]:
    """blocks: of falling length. What is stored of each."""
    sizes = np.array([len(b) for b in blocks])
    lanes, steps = len(blocks), int(sizes[0])
    tables, rows, room = [], np.zeros((lanes, steps), np.int16), np.empty(1 << 16, np.int16)
    for lane, block in enumerate(blocks):
        table, rows[lane, : len(block)] = _places(block, digits, room)
        tables.append(table)
    most = max(map(len, tables))
    places = _turned(rows)
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # lanes longer than the step
    guesses, held = _Guesses(lanes, most), np.zeros((steps, 2, lanes), np.int16)
    counts, lane0 = np.zeros(lanes * most, np.int16), np.arange(lanes) * most
    counts[lane0] = 1  # where nothing is remembered the first id is guessed, so it may never fail
    for t in range(steps):
        n = int(active[t])
        x = places[t, :n]
        held[t, :, :n] = found = guesses.of(n)
        right = found >> _TRUST == x
        guesses.learn(x, right)
        counts[lane0[:n] + x] += ~(right[0] | right[1])
    counts = counts.reshape(lanes, most).astype(np.int64)
    short = counts.sum(axis=1) > _ONE
    counts[short, 0] -= 1
    mixer = _Mixer(counts)

    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    words, at = np.zeros((steps * 2 * _BITS // 32 + 8) * lanes, np.uint64), np.arange(lanes)

    def shift(k: np.ndarray) -> None:
        """The top word leaves, with a carry in its 33rd bit where there was one."""
        had, to = low[k], at[k]
        words[to] = had >> _TOP
        at[k] = to + lanes
        low[k] = (had & _KEEP) << _WORD
        span[k] <<= _WORD

    for t in range(steps):
        n = int(active[t])
        mixer.weigh(held[t, :, :n])
        start, size = mixer.part(places[t, :n])
        part = span[:n] >> _TOTAL
        low[:n] += part * start
        span[:n] = part * size
        if len(k := np.flatnonzero(span[:n] < _LOW)):
            shift(k)
    for _ in range(2):
        shift(np.arange(lanes))
    at //= lanes
    words = words.reshape(-1, lanes)
    carry = np.zeros(lanes, np.uint64)
    for i in range(int(at.max()) - 1, -1, -1):
        word = words[i] + carry
        words[i], carry = word & np.uint64(0xFFFFFFFF), word >> _WORD
    coded = _turned(words[: at.max()].astype("<u4"))
    out = []
    for lane, (block, table) in enumerate(zip(blocks, tables)):
        stored = _table(table, counts[lane, : len(table)], digits) + coded[lane, : at[lane]].tobytes()
        plain = _TABLE.pack(0, 0) + block.astype(_plain(digits)).tobytes()
        stored = min(stored, plain, key=len)
        out.append(stored + b"\0" * (len(stored) % 2))
    return out


def _decode_lanes(stored: Sequence[bytes], sizes: Sequence[int], digits: int) -> list[np.ndarray]:
    """The ids of coded blocks of falling length."""
    sizes = np.array(sizes)
    lanes, steps = len(stored), int(sizes[0])
    tables, each = zip(*(_ids_and_words(data, digits) for data in stored))
    most = max(len(ids) for ids, _ in tables)
    counts, rows = np.zeros((lanes, most), np.int64), np.zeros((lanes, max(map(len, each)) + 3), "<u4")
    for lane, ((_, count), word) in enumerate(zip(tables, each)):
        counts[lane, : len(count)] = count
        rows[lane, : len(word)] = word
    mixer, guesses = _Mixer(counts), _Guesses(lanes, most)
    inverse, lane1 = np.repeat(np.tile(np.arange(most, dtype=np.int16), lanes), mixer.sizes.ravel()), np.arange(lanes) << _BITS
    words = _turned(rows).astype(np.uint64)
    # The window has a word and the top 30 bits of a second; so later words enter 2 bits late.
    value = (words[0] << _TOP) | (words[1] >> _TWO)
    late = (((words[1:-1] & _THREE) << _TOP) | (words[2:] >> _TWO)).ravel()
    span, at = np.full(lanes, _FULL), np.arange(lanes)
    places = np.zeros((steps, lanes), np.int16)
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    for t in range(steps):
        n = int(active[t])
        mixer.weigh(guesses.of(n))
        part = span[:n] >> _TOTAL
        x = mixer.found(np.minimum(value[:n] // part, _LAST).astype(np.int32), inverse, lane1[:n])
        places[t, :n] = x
        start, size = mixer.part(x)
        value[:n] -= part * start
        span[:n] = part * size
        if len(k := np.flatnonzero(span[:n] < _LOW)):
            row = at[k]
            value[k] = (value[k] << _WORD) | late.take(row, mode="clip")
            at[k] = row + lanes
            span[k] <<= _WORD
        guesses.learn(x, mixer.right)
    rows = _turned(places)
    return [ids[rows[lane, :size]] for lane, ((ids, _), size) in enumerate(zip(tables, sizes.tolist()))]


def _ids_and_words(data: bytes, digits: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    ids, counts, at = _read_table(data, digits)
    return (ids, counts), np.frombuffer(data, "<u4", (len(data) - at) // 4, at)


def _stored_crc(head: tuple[int, ...], stored: bytes) -> int:
    return zlib.crc32(stored, zlib.crc32(_HEAD.pack(*head, 0)))


def encode(ids: np.ndarray, digits: int, block: int = BLOCK) -> bytes:
    """The blocks of some ids, one after another. They are coded in step; where ids don't fill all lanes with blocks of
    this size, blocks are shorter, LEAST_BLOCK at least."""
    block = min(block, BLOCK, max(LEAST_BLOCK, -(-len(ids) // LANES)))
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> (4 * digits)):
        raise ValueError(f"an id has more than {digits} hexadecimal digits")
    blocks = [ids[i : i + block] for i in range(0, len(ids), block)]
    out: list[bytes] = []
    for a in range(0, len(blocks), LANES):
        for one, stored in zip(blocks[a : a + LANES], _encode_lanes(blocks[a : a + LANES], digits)):
            head = (len(one), len(stored) // 2, digits, zlib.crc32(one.astype("<u4").tobytes()))
            out += [_HEAD.pack(*head, _stored_crc(head, stored)), stored]
    return b"".join(out)


def decode(data: Iterator[bytes] | bytes) -> Iterator[np.ndarray]:
    """The ids of blocks, some blocks at a time. data: bytes, or parts of them that end anywhere. Blocks that are cut or
    do not match their checksum are an error."""
    held: list[tuple[int, int, int, bytes]] = []

    def flush() -> Iterator[np.ndarray]:
        digits = held[0][1]
        coded = [i for i, (_, _, _, stored) in enumerate(held) if stored[:2] != b"\0\0"]
        coded.sort(key=lambda i: -held[i][0])  # longest first
        found = dict(zip(coded, _decode_lanes([held[i][3] for i in coded], [held[i][0] for i in coded], digits))) if coded else {}
        ids = []
        for i, (n, _, crc, stored) in enumerate(held):
            one = found[i] if i in found else np.frombuffer(stored, _plain(digits), n, _TABLE.size)
            ids.append(one.astype("<u4"))
            if zlib.crc32(ids[-1].tobytes()) != crc:
                raise ValueError("a block of ids does not match its checksum")
        yield np.concatenate(ids)
        held.clear()

    rest = b""
    for part in [data] if isinstance(data, bytes) else data:
        rest, at = rest + part, 0
        while len(rest) - at >= _HEAD.size:
            *head, crc = _HEAD.unpack_from(rest, at)
            n, n_words, digits, ids_crc = head
            end = at + _HEAD.size + 2 * n_words
            if n == 0 or n_words < 3 or not 1 <= digits <= 8:
                raise ValueError("not a block of ids")
            if end > len(rest):
                break
            stored = rest[at + _HEAD.size : end]
            if _stored_crc(tuple(head), stored) != crc:
                raise ValueError("a block of ids does not match its checksum")
            if held and (held[0][1] != digits or len(held) == LANES):
                yield from flush()
            held.append((n, digits, ids_crc, stored))
            at = end
        rest = rest[at:]
    if rest:
        raise ValueError("the ids end within a block")
    if held:
        yield from flush()

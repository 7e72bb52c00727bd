"""A context-mixing range coder for token ids, many streams at a time.

A segment is sections of up to 4,194,304 ids. A section starts with its order-0 model: its different ids, each with how
often it stands there (to a quarter of a power of two). Ids are coded as places in that table. For each id the order-2
context (the two ids before) or else the order-1 context (the one before) proposes a candidate. How sure order 2 and
order 1 have been under their confidence, and how frequent the candidate is by order 0, are mixed in the logistic domain
with weights that learn; the mix is the probability of "it is the candidate". Where it isn't, order 0 codes the id.

The ids are cut into streams, and those of a section go in lockstep, so each numpy operation serves as many ids as there
are streams. All streams learn the same contexts; where several teach one context at once, the surest has it, so the
order of writes doesn't matter. Confidences and weights are learned from the sums of an epoch of steps, and the mix is
taken once an epoch for every case there is. All probabilities are integers, so coding and decoding agree on every machine.
Ids are any unsigned 32-bit integers.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Ids in a block, which has a checksum; ids in a section.
BLOCK = 8192
_SECTION = 1 << 22
#: Steps in an epoch; slots of order 1 and order 2; bits of the order-0 total, at least.
_EPOCH = 16
_SLOTS = (1 << 14, 1 << 18)
_SHIFT = 33 - _SLOTS[1].bit_length()
_BITS = 20
#: A weight moves by the mean slope over two to this power.
_RATE = 11
#: Ids below this are counted in an array, others by sorting.
_DIRECT = 1 << 22

#: A slot is the place that its context proposes, and from this bit on how sure it is (0: untaught, to 7).
_SURE = 28
_ONE, _PLACE = np.int32(1 << _SURE), np.int32((1 << _SURE) - 1)
#: What is taken off a slot that proposed another id.
_LESS = np.array([(sure - sure // 2) << _SURE for sure in range(8)], dtype=np.int32)
#: Cases of a prediction: how sure order 2 is (8), order 1 (8), whether they agree (2), the level of the candidate's share by order 0 (16).
_CASE = np.arange(2048)
_CASE2, _CASE1, _LEVEL = _CASE >> 8, (_CASE >> 4) & 15, _CASE & 15

_SQUASH = np.clip(np.round(65536 / (1 + np.exp(-np.arange(-2048, 2048) / 256.0))), 32, 65536 - 256).astype(np.int64)
_STRETCH = np.clip(np.round(np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096))) * 256), -2047, 2047).astype(np.int64)
#: The logit of each level of shares, in the mixer's unit.
_LOGIT = np.maximum(np.round(np.log(0.7 / (2.0 ** np.arange(16) - 0.7)) * 256), -2047).astype(np.int64)
#: Counts by level: level q stands for 2 ** (q / 4), here times 256.
_LEVELS = np.array([math.isqrt(math.isqrt(1 << (q + 32))) for q in range(128)], dtype=np.int64)

#: A stream's interval is [low, low + width) with width from 2 ** 31 to 2 ** 63; below that, 32 bits go out.
_FLOOR = np.uint64(1 << 31)
_1, _16, _31, _32, _33 = (np.uint64(n) for n in (1, 16, 31, 32, 33))
_WORD = np.uint64((1 << 32) - 1)


class _Order0:
    """The ids of a section, ascending, and the interval of each."""

    def __init__(self, ids: np.ndarray, levels: np.ndarray):
        self.ids, self.levels = ids, levels
        self.bits = bits = max(_BITS, (len(ids) - 1).bit_length() + 1) if len(ids) else _BITS
        counts, room = _LEVELS[levels].astype(object), (1 << bits) - len(ids)
        total = max(1, int(sum(counts.tolist())))
        freq = np.array([1 + c * room // total for c in counts.tolist()], dtype=np.int64)
        if len(ids):
            freq[int(levels.argmax())] += (1 << bits) - int(freq.sum())
        self.freq, self.start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        #: Of each id the level of its share: n for 2 ** -n to below twice that.
        self.share = np.minimum(bits + 1 - np.searchsorted(1 << np.arange(bits + 1), freq, side="right"), 15).astype(np.int32)

    @staticmethod
    def of(values: np.ndarray) -> tuple[_Order0, np.ndarray]:
        """The table of these ids, and the place of each of them in it."""
        if len(values) and values.max() < _DIRECT:
            counts = np.bincount(values)
            ids = np.flatnonzero(counts)
            counts, place = counts[ids], np.zeros(len(counts), dtype=np.int32)
            place[ids] = np.arange(len(ids), dtype=np.int32)
            places = place[values]
        else:
            ids, places, counts = np.unique(values, return_inverse=True, return_counts=True)
        levels = np.searchsorted(_LEVELS, counts.astype(np.int64) * 256, side="right") - 1
        return _Order0(ids.astype(np.uint32), levels.astype(np.uint8)), places.astype(np.int32)

    def places(self) -> np.ndarray:
        """The place that each value of the whole interval stands for."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))

    def packed(self) -> bytes:
        gaps = np.diff(self.ids.astype(np.int64), prepend=-1) - 1
        return zlib.compress(b"".join(((gaps >> shift) & 255).astype(np.uint8).tobytes() for shift in (0, 8, 16, 24)) + self.levels.tobytes(), 9)

    @staticmethod
    def unpacked(data: bytes) -> _Order0:
        parts = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(5, -1).astype(np.int64)
        ids = np.cumsum(parts[0] + (parts[1] << 8) + (parts[2] << 16) + (parts[3] << 24) + 1) - 1
        if len(ids) and (ids[-1] > 0xFFFFFFFF or parts[4].max() >= len(_LEVELS)):
            raise ValueError("the table of ids is damaged")
        return _Order0(ids.astype(np.uint32), parts[4].astype(np.uint8))


class _Model:
    """What the streams of a section have learned. predict() gives the candidates and their probabilities in 65536; update() learns the ids."""

    def __init__(self, streams: int, order0: _Order0):
        self.share = order0.share
        #: The contexts of order 1, then those of order 2.
        self.slots = np.zeros(sum(_SLOTS), dtype=np.int32)
        self.last, self.before = np.zeros(streams, dtype=np.uint32), np.zeros(streams, dtype=np.uint32)
        #: By how sure order 2 is, then by that of order 1 and whether they agree: how often that came and how often it was right, from a guess.
        self.seen, self.right = np.full(8 + 16, 64, dtype=np.int64), np.repeat(np.array([2, 16, 28, 36, 42, 46, 50, 54, 2, 8, 14, 18, 21, 23, 25, 27]), [1] * 8 + [2] * 8)
        #: By how sure order 2 is: the weights of order 2, order 1 and order 0.
        self.weights = np.repeat(np.array([[32_000], [24_000], [8_000]], dtype=np.int64), 8, axis=1)
        self.cases, self.hits = np.zeros(_EPOCH * streams, dtype=np.int32), np.zeros(_EPOCH * streams, dtype=np.int32)
        self.kept, self.left = 0, _EPOCH
        self._mix()

    def _mix(self) -> None:
        p = _STRETCH[self.right * 4095 // self.seen]
        self.s = np.stack([p[_CASE2], p[8 + _CASE1], _LOGIT[_LEVEL]])
        dot = (self.weights[:, _CASE2] * self.s).sum(axis=0) >> 16
        self.p = _SQUASH[np.clip(dot, -2048, 2047) + 2048]
        self.odds = self.p.astype(np.uint64)

    def _learn(self) -> None:
        """Learns from the cases of the epoch."""
        counts = np.bincount(self.cases[: self.kept] * 2 + self.hits[: self.kept], minlength=2 * len(_CASE)).reshape(8, 16, 16, 2)
        hits, seen = counts[..., 1], counts.sum(axis=3)
        self.seen += np.concatenate([seen.sum(axis=(1, 2)), seen.sum(axis=(0, 2))])
        self.right += np.concatenate([hits.sum(axis=(1, 2)), hits.sum(axis=(0, 2))])
        slope = (self.s * (hits.ravel() * 65536 - seen.ravel() * self.p)).reshape(3, 8, -1).sum(axis=2)
        self.weights += slope // (seen.sum(axis=(1, 2)) + 256) >> _RATE
        self.kept, self.left = 0, _EPOCH
        self._mix()

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the first n streams: the candidate and its probability."""
        self.at = at = np.empty((2, n), dtype=np.int64)
        last = self.last[:n]
        np.bitwise_and(last, _SLOTS[0] - 1, out=at[0])
        mixed = last * 0x9E3779B1
        mixed ^= self.before[:n] * 0x85EBCA77
        mixed >>= _SHIFT
        np.add(mixed, _SLOTS[0], out=at[1])
        self.slot = slot = self.slots.take(at)
        self.place = place = slot & _PLACE
        sure = slot >> _SURE
        candidate = np.where(sure[1] > 0, place[1], place[0])
        case = self.cases[self.kept : self.kept + n]
        np.left_shift(sure[1], 3, out=case)
        case |= sure[0]
        case <<= 1
        case |= place[0] == candidate
        case <<= 4
        case |= self.share.take(candidate)
        self.sure = sure
        return candidate, self.odds.take(case)

    def update(self, n: int, now: np.ndarray, hit: np.ndarray) -> None:
        self.hits[self.kept : self.kept + n] = hit
        slot, sure = self.slot, self.sure
        # the same id: surer; another one: less sure, or taken over by it
        other = np.where(sure > 1, slot - _LESS.take(sure), now + _ONE)
        slot = np.where(self.place == now, slot + (sure < 7) * _ONE, other)
        at = self.at.ravel()
        self.slots[at] = 0
        np.maximum.at(self.slots, at, slot.ravel())
        self.before[:n], self.last[:n] = self.last[:n], now
        self.kept, self.left = self.kept + n, self.left - 1
        if not self.left:
            self._learn()


def _stream(n: int) -> int:
    """How many ids of a section of n stand in a stream: about as many as there are streams, so that steps aren't many and narrow."""
    return min(2048, max(256, 1 << n.bit_length() // 2))


def _coded(places: np.ndarray, order0: _Order0) -> tuple[np.ndarray, np.ndarray]:
    """The words of the streams, one stream's after the other, and of each stream how many."""
    size = len(places)
    rows = min(_stream(size), size)
    streams = -(-size // rows)
    rest = size - (streams - 1) * rows
    grid = np.zeros(rows * streams, dtype=np.int32)
    grid[:size] = places
    grid = np.ascontiguousarray(grid.reshape(streams, rows).T)
    out, ready = np.zeros((rows + 1, streams), dtype=np.uint64), np.zeros((rows + 1, streams), dtype=bool)
    model, low, width = _Model(streams, order0), np.zeros(streams, dtype=np.uint64), np.full(streams, (1 << 63) - 1, dtype=np.uint64)
    freq, start, bits = order0.freq, order0.start, np.uint64(order0.bits)
    for step in range(rows):
        if step == rest:
            out[rows, -1] = low[-1]
            streams -= 1
            low, width = low[:-1], width[:-1]
        now = grid[step, :streams]
        candidate, p = model.predict(streams)
        hit = candidate == now
        cut = width >> _16
        cut *= p
        width -= cut
        width >>= bits
        past = width * start.take(now)
        past += cut
        past *= ~hit
        low += past
        width *= freq.take(now)
        np.copyto(width, cut, where=hit)
        model.update(streams, now, hit)
        need = np.less(width, _FLOOR, out=ready[step, :streams])
        np.right_shift(low, _31, out=out[step, :streams])
        np.copyto(low, (low << _33) >> _1, where=need)
        width <<= need * _32
    out[rows, :streams] = low
    out[rows] += _FLOOR - _1
    out[rows] >>= _31
    np.greater(out[rows], 0, out=ready[rows])  # past a stream's end zeros are read
    words, counts = out.T[ready.T], ready.sum(axis=0)
    carry = words >> _32
    while carry.any():
        words &= _WORD
        words[:-1] += carry[1:]
        carry = words >> _32
    return words.astype("<u4"), counts


def _read(words: np.ndarray, counts: np.ndarray, size: int, order0: _Order0) -> np.ndarray:
    """The places of the streams' ids. Of damaged words it makes other places; the checksums tell."""
    streams = len(counts)
    rows = min(_stream(size), size)
    rest = size - (streams - 1) * rows
    padded, first = np.zeros(len(words) + 3 * streams, dtype=np.uint64), np.cumsum(counts + 3) - (counts + 3)
    padded[np.arange(len(words)) + 3 * np.repeat(np.arange(streams), counts)] = words
    # the code starts with 63 bits and goes on 32 at a time, so these begin with a word's last bit
    after = ((padded[:-1] << _31) & _WORD) | (padded[1:] >> _1)
    code, at = (padded[first] << _31) | (padded[first + 1] >> _1), first + 1
    model, width = _Model(streams, order0), np.full(streams, (1 << 63) - 1, dtype=np.uint64)
    freq, start, bits = order0.freq, order0.start, np.uint64(order0.bits)
    places, most = order0.places(), np.uint64((1 << order0.bits) - 1)
    grid = np.zeros((rows, streams), dtype=np.int32)
    for step in range(rows):
        if step == rest:
            streams -= 1
            code, width, at = code[:-1], width[:-1], at[:-1]
        candidate, p = model.predict(streams)
        cut = width >> _16
        cut *= p
        hit = code < cut
        width -= cut
        width >>= bits
        value = code - cut
        value //= width
        np.minimum(value, most, out=value)
        now = np.where(hit, candidate, places.take(value.view(np.int64)))
        past = width * start.take(now)
        past += cut
        past *= ~hit
        code -= past
        width *= freq.take(now)
        np.copyto(width, cut, where=hit)
        model.update(streams, now, hit)
        grid[step, :streams] = now
        need = width < _FLOOR
        np.copyto(code, (code << _32) | after.take(at, mode="clip"), where=need)
        at += need
        width <<= need * _32
    return grid.T.ravel()[:size]


_HEAD = struct.Struct("<4sIQII")
_MAGIC = b"GWT3"


def _packed(ids: np.ndarray, total: int) -> bytes:
    order0, places = _Order0.of(ids)
    words, counts = _coded(places, order0) if len(ids) else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))
    plain, table = ids.astype("<u4"), order0.packed()
    sums = np.array([zlib.crc32(plain[i : i + BLOCK].tobytes()) for i in range(0, len(ids), BLOCK)], dtype="<u4")
    head = b"".join([_HEAD.pack(_MAGIC, BLOCK, total, len(ids), len(table)), table, sums.tobytes(), counts.astype("<u2").tobytes()])
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), words.tobytes()])


def pack(ids: np.ndarray) -> bytes:
    """A segment: its sections, each a head (magic, block size, ids of the segment, ids of the section, bytes of the table), the table of ids, for each block the CRC-32 of its ids as little-endian unsigned 32-bit integers, for each stream its 32-bit words, the CRC-32 of all this, then the streams."""
    ids = np.asarray(ids, dtype=np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFFFFFF):
        raise ValueError("ids must be unsigned 32-bit integers")
    return b"".join([_packed(ids[i : i + _SECTION], len(ids)) for i in range(0, max(1, len(ids)), _SECTION)])


def unpack(segment: bytes) -> np.ndarray:
    """The ids of a segment as unsigned 32-bit integers; ValueError if it isn't one, is cut short, or a checksum doesn't hold."""
    parts, done, total, at = [], 0, None, 0
    while total is None or done < total:
        if len(segment) < at + _HEAD.size:
            raise ValueError("not a segment of this format, or cut short")
        magic, block, of, n, size = _HEAD.unpack_from(segment, at)
        if magic != _MAGIC or block != BLOCK:
            raise ValueError("not a segment of this format")
        blocks, streams, table = -(-n // BLOCK), -(-n // _stream(n)), at + _HEAD.size
        end = table + size + 4 * blocks + 2 * streams
        if end + 4 > len(segment) or zlib.crc32(segment[at:end]) != struct.unpack_from("<I", segment, end)[0]:
            raise ValueError("the head of a section is damaged")
        if n != min(_SECTION, of - done) or (total is not None and of != total):
            raise ValueError("a section is missing")
        sums, counts = np.frombuffer(segment, dtype="<u4", count=blocks, offset=table + size), np.frombuffer(segment, dtype="<u2", count=streams, offset=end - 2 * streams).astype(np.int64)
        length = int(counts.sum())
        at = end + 4 + 4 * length
        if at > len(segment):
            raise ValueError("the segment is cut short")
        order0 = _Order0.unpacked(segment[table : table + size])
        if n:
            ids = order0.ids[_read(np.frombuffer(segment, dtype="<u4", count=length, offset=end + 4), counts, n, order0)].astype("<u4")
            for i, own in enumerate(sums.tolist()):
                if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes()) != own:
                    raise ValueError(f"block {done // BLOCK + i} is damaged")
            parts.append(ids)
        done, total = done + n, of
    if at != len(segment):
        raise ValueError("there is more than the segment")
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")

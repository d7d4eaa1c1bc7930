"""An adaptive context-mixing range coder for token ids, over many blocks at once.

Each block of ids is coded by a model of its own that starts from nothing but the segment's list of
ids by falling frequency. Order 2 predicts the id seen last after the same two ids, order 1 the one
seen last after the same id. How often predictions of like confidence have come true is counted for
both orders, and both views are mixed by a weight that follows their success; this gives the odds of
the first prediction, of the second and of neither. In that case order 0 codes the id: adaptive
counts of frequency ranks, exact for the first ranks and by runs of ranks after them, whose last
bits, all equally likely, are written as they are.

Blocks are independent, so all blocks of a segment are coded in step, one numpy operation serving
one id of every block. Low ends and widths are whole numbers below 2**49: of 64 bits in the writer,
in the reader doubles that hold them exactly, as these divide faster. A segment starts with its
checksummed list of ids; each block has its lengths and the CRC-32 of its ids.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK_IDS, LANES, MOST_LANES = 1024, 512, 8192
SLOTS = 7  # bits of a block's prediction tables
_MAGIC = b"TWR3"
_TOP, _FULL, _TOTAL = 1 << 32, 1 << 48, 1 << 16
#: Order 0's share of all odds at least, and the sum of its own counts.
_LEAST_ESCAPE, _ZERO = 2048, 1024
#: Runs of ranks: 16 of one rank, then two to each doubling up to 2**16; _HIT stands for a prediction.
_BITS = np.array([0] * 16 + [b for b in range(3, 15) for _ in range(2)], np.int32)
_FIRST = (np.cumsum(1 << _BITS) - (1 << _BITS)).astype(np.int32)
_RUNS, _HIT = len(_BITS), len(_BITS) + 1
_RUN_OF = np.repeat(np.arange(_RUNS, dtype=np.int32), 1 << _BITS)
_MASK = (1 << _BITS) - 1
_BITS, _FIRST, _MASK = (np.append(x, np.zeros(2, np.int32)) for x in (_BITS, _FIRST, _MASK))
#: Ids after which the counts of order 0 are summed up anew, beside every _EVERY.
_EARLY, _EVERY = {4, 8, 16, 24}, 32


def _by_frequency(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """How often each id occurs, as the bits of its count, and these packed."""
    counts = np.bincount(ids)
    bits = np.frexp(counts.astype(np.float64))[1].astype(np.uint8)
    return bits, zlib.compress(bits.tobytes(), 1)


def _ranks(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids by falling bits of their counts, padded to 2**16, and order 0's first counts of runs."""
    order = np.argsort(-bits.astype(np.int64), kind="stable")
    weight = np.exp2(bits[order].astype(np.float64)) * (bits[order] > 0)
    mass = np.bincount(_RUN_OF[: len(order)], weights=weight, minlength=_RUNS)
    ids = np.zeros(_TOTAL, np.uint32)
    ids[: len(order)] = order
    return ids, 24 * mass / max(mass.sum(), 1)


class _Model:
    """The adaptive state of `n` blocks. Places are whole numbers of 64 bits, which numpy takes as they are."""

    def __init__(self, n: int, prior: np.ndarray):
        self.n, self.lane = n, np.arange(n)
        self.slot0, self.odds0, self.hits = self.lane << SLOTS, self.lane << 3, self.lane + _HIT * n
        self.two, self.one = np.zeros(n << SLOTS, np.int32), np.zeros(n << SLOTS, np.int32)  # rank << 2 | confidence
        # by confidence, and by whether the predictions differ: odds of 2**16 that the first one is right, by order 2's view and by order 1's, and odds of 2**15 of the second one
        first = np.array([3000, 30000, 46000, 56000, 2000, 20000, 36000, 50000], np.int32)
        self.by2, self.by1 = np.tile(first, n), np.tile(first << 15 | np.array([1000, 7000, 12000, 16000] * 2, np.int32), n)
        self.weight = np.full(n, 160, np.int32)
        # arrays, as numpy's extrema are slow with scalars
        self.three, self.most, self.end, self.least_weight, self.most_weight = (np.full(n, x, np.int32) for x in (3, _TOTAL - 2 * _LEAST_ESCAPE, _TOTAL - _LEAST_ESCAPE, 16, 240))
        self.counts = np.repeat(np.append(prior, [0.0, 0.0]), n).reshape(_HIT + 1, n)
        self.cells, self.new = np.zeros((_EVERY, n), np.int64), 0  # places of counts since they were summed up
        self.at1 = self.at2 = self.slot0
        self.before = np.zeros(n, np.int32)
        self.step = 0
        # where the share of each run begins, of _ZERO; that of _HIT is the whole
        self.cum = np.zeros((_HIT + 2, n), np.uint16)
        self.cum[_RUNS] = self.cum[_HIT + 1] = _ZERO
        self.begins = self.cum.ravel()
        self.sum_up()

    def sum_up(self) -> None:
        if self.new:
            self.counts += np.bincount(self.cells[: self.new].ravel(), minlength=self.counts.size).reshape(self.counts.shape)
            self.new = 0
        scale = (_ZERO - _RUNS) / np.maximum(self.counts[:_RUNS].sum(axis=0), 1e-9)
        total = np.zeros(self.n)
        for run in range(_RUNS - 1):
            total += self.counts[run]
            self.cum[run + 1] = total * scale + (run + 1)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the odds of the first prediction and of the second one end; what is above is order 0's."""
        e1, e2 = self.one.take(self.at1, mode="clip"), self.two.take(self.at2, mode="clip")
        self.p1, self.p2, self.c1, self.c2 = e1 >> 2, e2 >> 2, e1 & 3, e2 & 3
        differ = self.p1 != self.p2
        odds = (differ << 2) + self.odds0
        self.k1, self.k2 = odds + self.c1, odds + self.c2
        self.x2, g1 = self.by2.take(self.k2, mode="clip"), self.by1.take(self.k1, mode="clip")
        self.x1, self.x0 = g1 >> 15, g1 & 32767
        x = np.minimum(((self.x2 - self.x1) * self.weight >> 8) + self.x1, self.most)
        y = np.minimum(((_TOTAL - x >> 2) * self.x0 >> 13) * differ + x, self.end)
        return x, y

    def interval(self, x: np.ndarray, y: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, escape: np.ndarray, of_run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where what is coded begins in _TOTAL, and its width there; of_run is the place of its run's count after the place of _HIT."""
        cell = self.cells[self.new]
        np.multiply(of_run, escape, out=cell)
        cell += self.hits
        self.new += 1
        second = y - x
        share = hit2 * x + hit1 * second + escape * (_TOTAL - y)
        begin = share * self.begins.take(cell, mode="clip") >> 10
        width = (share * self.begins.take(cell + self.n, mode="clip") >> 10) - begin
        return begin + (x - hit2 * x) + escape * second, width

    def learn(self, ranks: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Takes the next rank of each block, and 1 where a prediction had it. Odds learn from every second id; they stay where each prediction keeps a share."""
        if self.step & 1:
            goal = hit2 * 65471 + 64
            d2, d1 = goal - self.x2, goal - self.x1
            self.weight = np.minimum(np.maximum((np.abs(d1) - np.abs(d2) >> 11) + self.weight, self.least_weight), self.most_weight)
            self.by2[self.k2] = (d2 >> 4) + self.x2
            x0 = ((hit1 * 32511 + 256 - self.x0) >> 4) * (1 - hit2) + self.x0
            self.by1[self.k1] = ((d1 >> 4) + self.x1 << 15) + x0
        new = ranks << 2
        self.two[self.at2] = np.minimum(self.c2 + 1, self.three) * hit2 + new
        self.one[self.at1] = np.minimum(self.c1 + 1, self.three) * (self.p1 == ranks) + new
        mask = (1 << SLOTS) - 1
        self.at1 = (ranks & mask) + self.slot0
        self.at2 = (ranks * 0x2F35 + self.before & mask) + self.slot0
        self.before = ranks * 0x51ED
        self.step += 1
        if self.step % _EVERY == 0 or self.step in _EARLY:
            self.sum_up()


def block_size(n: int) -> int:
    """Ids of a block for n ids: a power of two that gives some hundreds of blocks to code in step, BLOCK_IDS at most."""
    return min(BLOCK_IDS, max(256, 1 << max(0, n // LANES - 1).bit_length()))


def _packed_bits(values: np.ndarray, length: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each row, each in as many bits as length says, one after the other: all bytes, and the n + 1 offsets in them.

    Counts says how many of the values are each row's. Each row fills whole words of 32 bits; a
    number has 1 to 32 bits.
    """
    ends = np.r_[0, np.cumsum(length, dtype=np.int64)]
    last = ends[np.r_[0, np.cumsum(counts)]]
    words = np.r_[0, np.cumsum((np.diff(last) + 31) >> 5)]
    at = ends[:-1] + np.repeat((words[:-1] << 5) - last[:-1], counts)
    out = np.zeros(words[-1] + 1, np.int64)
    if len(at):
        word = at >> 5
        at &= 31
        value = values.astype(np.int64) << at
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.add.reduceat(value & 0xFFFFFFFF, first)
        over = np.flatnonzero(value >> 32)  # one number at most runs into the next word
        out[word[over] + 1] |= value[over] >> 32
    return out[:-1].astype("<u4").view(np.uint8), words << 2


def _encode_segment(ids: np.ndarray, block: int) -> bytes:
    n = -(-len(ids) // block)
    bits, listed = _by_frequency(ids)
    by_rank, prior = _ranks(bits)
    rank_of = np.zeros(len(bits), np.int32)
    rank_of[by_rank[: len(bits)]] = np.arange(len(bits))
    ranks = np.zeros(n * block, np.int32)
    ranks[: len(ids)] = rank_of[ids]
    table = np.ascontiguousarray(ranks.reshape(n, block).T)
    run_of = (_RUN_OF - _HIT) * n
    escaped = np.zeros((block, n), bool)
    model = _Model(n, prior)
    low, width = np.zeros(n, np.int64), np.full(n, _FULL - 1)
    stride = block + 8
    out, at = np.zeros(n * stride, np.uint16), np.arange(n) * stride
    for t in range(block):
        now = table[t]
        x, y = model.predict()
        hit2 = model.p2 == now
        hit1 = (model.p1 == now) > hit2
        escape = np.equal(hit2, hit1, out=escaped[t])
        hit2, hit1 = hit2.astype(np.int32), hit1.astype(np.int32)
        begin, share = model.interval(x, y, hit2, hit1, escape.astype(np.int32), run_of.take(now, mode="clip"))
        width >>= 16
        low += width * begin
        width *= share
        if low.max() >= _FULL:
            who = np.flatnonzero(low >= _FULL)
            low[who] -= _FULL
            back = at[who] - 1
            while len(back):
                out[back] += np.uint16(1)
                back = back[out[back] == 0] - 1
        short = width < _TOP
        word = low >> 32
        out[at] = word
        at += short
        low -= (word << 32) * short
        shift = short << 4
        low <<= shift
        width <<= shift
        model.learn(now, hit2, hit1)
    at -= np.arange(n) * stride
    out = np.concatenate([out.reshape(n, stride)[:, : block + 4], np.zeros((n, 4), np.uint16)], axis=1)
    for k, shift in enumerate((32, 16, 0)):
        out[np.arange(n), at + k] = low >> shift & 0xFFFF
    # the last bits of escaped ranks above the runs of one
    used = np.flatnonzero(np.ascontiguousarray(escaped.T).ravel() & (ranks >= 16))
    rank = ranks.take(used)
    run = _RUN_OF.take(rank)
    tail, tail_at = _packed_bits(rank - _FIRST.take(run), _BITS.take(run), np.diff(np.searchsorted(used, np.arange(n + 1) * block)))
    parts = [_MAGIC, np.array([len(ids), block, len(bits), len(listed), zlib.crc32(listed)], "<u4").tobytes(), listed]
    plain = ids.astype("<u4")
    sizes = np.stack([at + 3, np.diff(tail_at), [zlib.crc32(plain[i * block : (i + 1) * block]) for i in range(n)]], axis=1)
    parts.append(sizes.astype("<u4").tobytes())
    for i in range(n):
        parts += [out[i, : at[i] + 3].astype("<u2").tobytes(), tail[tail_at[i] : tail_at[i + 1]].tobytes()]
    return b"".join(parts)


def encode(ids: np.ndarray, block: int | None = None) -> bytes:
    """All ids (each below 2**16) in blocks of `block` ids, the last one shorter, in even segments of at most MOST_LANES blocks."""
    block = block or block_size(len(ids))
    n = -(-len(ids) // block)
    step = block * max(1, -(-n // max(1, -(-n // MOST_LANES))))
    return b"".join(_encode_segment(ids[a : a + step], block) for a in range(0, len(ids), step))


def _decode_segment(data: memoryview) -> tuple[np.ndarray, int]:
    """The ids of the segment at the start of data, and its length in bytes."""
    if len(data) < 24 or data[:4] != _MAGIC:
        raise ValueError("not a segment of coded ids")
    total, block, kinds, size, check = np.frombuffer(data, "<u4", 5, 4).tolist()
    listed = bytes(data[24 : 24 + size])
    if zlib.crc32(listed) != check or not block:
        raise ValueError("a segment's list of ids doesn't match its checksum")
    bits = np.frombuffer(zlib.decompress(listed), np.uint8)
    if len(bits) != kinds:
        raise ValueError("a segment's list of ids is cut short")
    by_rank, prior = _ranks(bits)
    n, at = -(-total // block), 24 + size
    sizes = np.frombuffer(data, "<u4", 3 * n, at).reshape(n, 3).astype(np.int64)
    at += 12 * n
    ends = np.cumsum(2 * sizes[:, 0] + sizes[:, 1])
    begins = at + ends - 2 * sizes[:, 0] - sizes[:, 1]
    if at + ends[-1] > len(data):
        raise ValueError("a segment is cut short")
    # reads past the end of spoilt blocks find zeros, and the checksum tells
    words = np.frombuffer(b"".join([bytes(data[b : b + 2 * w]) for b, w in zip(begins, sizes[:, 0], strict=True)]) + bytes(2 * block + 16), "<u2").astype(np.float64)
    tail = np.frombuffer(b"".join([bytes(data[b + 2 * w : b + 2 * w + k]) for b, (w, k, _) in zip(begins, sizes, strict=True)]) + bytes(2 * block + 16), np.uint8).astype(np.int32)
    tail = tail[:-2] | tail[1:-1] << 8 | tail[2:] << 16
    place = np.cumsum(sizes[:, 0]) - sizes[:, 0]
    bit = (np.cumsum(sizes[:, 1]) - sizes[:, 1]) << 3
    code = (words[place] * _TOTAL + words[place + 1]) * _TOTAL + words[place + 2]
    place += 3
    width = np.full(n, float(_FULL - 1))
    model = _Model(n, prior)
    cum, last_run, highest = model.cum[:_RUNS], np.full(n, _RUNS), np.full(n, _TOTAL - 1.0)
    table = np.zeros((block, n), np.int32)
    for t in range(block):
        x, y = model.predict()
        width = np.floor(width * (1 / _TOTAL))
        v = np.minimum(code / width, highest).astype(np.int32)
        hit2, escape = v < x, v >= y
        hit1 = (hit2 == escape).astype(np.int32)
        hit2 = hit2.astype(np.int32)
        # order 0: the last run whose share of the rest begins at or before v
        key = (((v - y + 1) * float(_ZERO) - 1) * escape / (_TOTAL - y)).astype(np.uint16)
        run = np.minimum(np.add.reduce((cum <= key).view(np.uint8), axis=0, dtype=np.uint8), last_run) - 1
        begin, share = model.interval(x, y, hit2, hit1, escape.astype(np.int32), (run - _HIT) * n)
        code -= width * begin
        width *= share
        short = width < _TOP
        scale = short * 65535.0 + 1.0
        code = code * scale + words.take(place, mode="clip") * short
        width *= scale
        place += short
        run = (run - _HIT) * escape + _HIT
        low = (tail.take(bit >> 3, mode="clip") >> (bit & 7)) & _MASK.take(run, mode="clip")
        bit += _BITS.take(run, mode="clip")
        now = np.add(_FIRST.take(run, mode="clip") + low, hit2 * model.p2 + hit1 * model.p1, out=table[t], casting="same_kind")
        model.learn(now, hit2, hit1)
    ids = by_rank[table.T.ravel()[:total]]
    for i in range(n):
        if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) != sizes[i, 2]:
            raise ValueError(f"block {i} doesn't match its checksum")
    return ids, int(at + ends[-1])


def decode(data: bytes) -> np.ndarray:
    """The ids that `encode` wrote; a block that doesn't match its checksum raises ValueError."""
    view, found = memoryview(data), [np.zeros(0, np.uint32)]
    while len(view):
        ids, size = _decode_segment(view)
        found.append(ids)
        view = view[size:]
    return np.concatenate(found)

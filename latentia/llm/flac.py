"""FLAC frames in numpy: Rice residuals, fixed and LPC predictors, CRC-8 / CRC-16 / MD5, seek points.

Written from the public format description (RFC 9639); mono, 4 to 16 bits a sample.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BLOCK = 4096
PARTS_LOG = 3
STRIDE = 16
#: Fixed values of the format: binomial predictor coefficients by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that does not decode or fails a checksum."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t


CRC8 = _crc_table(0x07, 8).tolist()
CRC16 = _crc_table(0x8005, 16)
_reach: list[np.ndarray] = []


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(data: bytes, chunk: int = 8192) -> int:
    """CRC-16 by linearity: each byte's share depends on its value and distance from the end."""
    if not _reach:
        rows = np.empty((chunk, 256), np.uint16)
        rows[0] = CRC16
        for d in range(1, chunk):
            x = rows[d - 1].astype(np.int64)
            rows[d] = ((x << 8) & 0xFFFF) ^ CRC16[x >> 8]
        _reach.append(rows.ravel())
    c = 0
    for at in range(0, len(data), chunk):
        part = np.frombuffer(data, np.uint8, min(chunk, len(data) - at), at).astype(np.int64)
        part[0] ^= c >> 8
        if len(part) > 1:
            part[1] ^= c & 255
        far = np.arange(len(part) - 1, -1, -1) * 256
        own = int(np.bitwise_xor.reduce(_reach[0][far + part]))
        c = own if len(part) > 1 else own ^ ((c & 255) << 8)
    return c


def packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields of ``widths`` bits one after the other, each with a value of at most 32 bits at its end, zero bits up to a whole byte."""
    at = np.cumsum(widths, dtype=np.int64)
    word, v, n = (at - 1) >> 5, values.astype(np.int64) << (31 - ((at - 1) & 31)), -(-int(at[-1]) // 32)
    words = np.bincount(word, v & 0xFFFFFFFF, n)
    over = np.flatnonzero(v >> 32)
    words += np.bincount(word[over] - 1, v[over] >> 32, n)
    return words.astype(np.int64).astype(">u4").tobytes()[: -(-int(at[-1]) // 8)]


def utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1 if s > 1 else 7))
    tail = [0x80 | n >> (6 * i) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size)) & 0xFF | n >> (6 * (size - 1)), *tail])


class Rice(NamedTuple):
    """Folded residuals with the parameter of each partition, and the bits they take."""

    u: np.ndarray
    log: int
    sizes: np.ndarray
    k: np.ndarray
    cost: int


def rice_plan(res: np.ndarray, block: int, order: int, parts_log: int) -> Rice:
    log = parts_log if block % (1 << parts_log) == 0 and block >> parts_log > order else 0
    u = (res << 1) ^ (res >> 63)
    sizes = np.full(1 << log, block >> log)
    sizes[0] -= order
    starts = np.cumsum(sizes) - sizes
    near = np.log2(np.maximum(np.add.reduceat(u, starts) / sizes, 1)).astype(np.int64)
    tried = np.minimum(np.maximum(near + np.arange(-1, 2)[:, None], 0), 14)
    high = [np.array([(u >> t[0]).sum()]) if not log else np.add.reduceat(u >> np.repeat(t, sizes), starts) for t in tried]
    cost = np.array(high) + sizes * (tried + 1)
    return Rice(u, log, sizes, tried[cost.argmin(0), np.arange(1 << log)], 6 + 4 * len(sizes) + int(cost.min(0).sum()))


def rice_fields(r: Rice) -> tuple[np.ndarray, np.ndarray]:
    """Values and widths of a residual section: method, partition order, parameters and codes."""
    k = np.repeat(r.k, r.sizes) if r.log else r.k
    values, widths = (r.u & (1 << k) - 1) | 1 << k, (r.u >> k) + k + 1
    if not r.log:
        return np.concatenate([[0], r.k, values]), np.concatenate([[6, 4], widths])
    starts = np.cumsum(r.sizes) - r.sizes
    return np.concatenate([[r.log], np.insert(values, starts, r.k)]), np.concatenate([[6], np.insert(widths, starts, 4)])


def lpc_coefficients(x: np.ndarray, order: int, precision: int = 12) -> tuple[list[int], int]:
    """Quantised predictor from the autocorrelation, and its shift."""
    x = x.astype(np.float64)
    r = np.array([np.dot(x[: len(x) - i], x[i:]) for i in range(order + 1)])
    lag = np.arange(order)
    m = r[np.abs(lag[:, None] - lag)]
    m[lag, lag] += 1e-6 * r[0] + 1
    c = np.linalg.solve(m, r[1:])
    shift = min(max(int(precision - 2 - np.ceil(np.log2(np.abs(c).max() + 1e-9))), 0), 15)
    limit = (1 << (precision - 1)) - 1
    return np.minimum(np.maximum(np.rint(c * (1 << shift)), -limit), limit).astype(np.int64).tolist(), shift


def subframe(x: np.ndarray, bps: int, lpc: int, parts_log: int) -> bytes:
    """A constant, else the smaller in bits of the best fixed predictor and (``lpc`` > 0) the linear predictor of that order."""
    mask = (1 << bps) - 1
    if (x == x[0]).all():
        return packed(np.array([0, int(x[0]) & mask]), np.array([8, bps]))
    diffs = [x]
    for _ in range(min(4, len(x) - 1)):
        diffs.append(np.diff(diffs[-1]))
    order = min(range(len(diffs)), key=lambda o: int(np.abs(diffs[o]).sum()))
    plan, kind, more = rice_plan(diffs[order], len(x), order, parts_log), 8 + order, ([], [])
    if lpc and len(x) > 4 * lpc:
        c, shift = lpc_coefficients(x, lpc)
        guess = np.convolve(x.astype(np.float64), c)[lpc - 1 : len(x) - 1].astype(np.int64) >> shift
        other = rice_plan(x[lpc:] - guess, len(x), lpc, parts_log)
        if other.cost + bps * lpc + 9 + 12 * lpc < plan.cost + bps * order:
            plan, order, kind, more = other, lpc, 31 + lpc, ([11, shift, *[v & 0xFFF for v in c]], [4, 5, *[12] * lpc])
    values, widths = rice_fields(plan)
    return packed(np.concatenate([[kind << 1], x[:order] & mask, np.array(more[0], np.int64), values]), np.concatenate([[8], np.full(order, bps), np.array(more[1], np.int64), widths]))


def encode(samples: np.ndarray, bps: int = 8, rate: int = 8000, block: int = BLOCK, lpc: int = 0, parts_log: int = PARTS_LOG) -> bytes:
    """A whole stream with STREAMINFO, a seek point for each frame, and the frames; ``lpc``: order of the linear predictors tried."""
    x = samples.astype(np.int64)
    size_code = {8: 1, 12: 2, 16: 4}.get(bps, 0)
    frames = []
    for number, at in enumerate(range(0, len(x), block)):
        part = x[at : at + block]
        head = bytes([0xFF, 0xF8, 0x70, size_code << 1]) + utf8_number(number) + struct.pack(">H", len(part) - 1)
        frame = head + bytes([crc8(head)]) + subframe(part, bps, lpc, parts_log)
        frames.append(frame + struct.pack(">H", crc16(frame)))
    sizes = [len(f) for f in frames] or [0]
    raw = samples.astype("<i2" if bps > 8 else np.int8).tobytes()
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (rate << 44 | (bps - 1) << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    seeks, at = [], 0
    for i, f in enumerate(frames):
        seeks.append(struct.pack(">QQH", i * block, at, min(block, len(x) - i * block)))
        at += len(f)
    table = b"".join(seeks)
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


class Info(NamedTuple):
    block: int
    most: int  # bytes of the largest frame, 0: unknown
    rate: int
    bps: int
    samples: int
    md5: bytes
    first: int  # where frames begin
    seeks: list[tuple[int, int, int]]


class Block(NamedTuple):
    sample_offset: int
    byte_offset: int
    samples: np.ndarray


def read_info(data: bytes) -> Info:
    if data[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, last, info, seeks = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata cut off")
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body, at = data[at + 4 : at + 4 + n], at + 4 + n
        if len(body) < n:
            raise FlacError("metadata cut off")
        if kind == 0:
            if n < 34:
                raise FlacError("short stream information")
            word = int.from_bytes(body[10:18], "big")
            info = (int.from_bytes(body[2:4], "big"), int.from_bytes(body[7:10], "big"), word >> 44, (word >> 36 & 31) + 1, word & (1 << 36) - 1, body[18:34])
            if word >> 41 & 7:
                raise FlacError("more than one channel")
        elif kind == 3:
            seeks = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, n - 17, 18)]
    if info is None:
        raise FlacError("no stream information")
    return Info(*info, at, seeks)


class Bits:
    """Bit positions of a frame: fields, and chains of Rice codes found by jumping from stop bit to stop bit."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0
        byte = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
        self.words = byte[:-3] << 24 | byte[1:-2] << 16 | byte[2:-1] << 8 | byte[3:]  # four bytes from each byte on
        self.ones = np.flatnonzero(self.bits.view(np.bool_))
        self.before = np.zeros(len(self.bits) + 1, np.intp)
        np.cumsum(self.bits, dtype=np.intp, out=self.before[1:])
        self.jumps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        if self.at > len(self.bits):
            raise FlacError("frame cut off")
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def signed_many(self, count: int, n: int) -> np.ndarray:
        rows = self.bits[self.at : self.at + count * n].reshape(count, n).astype(np.int64)
        self.at += count * n
        return rows @ (1 << np.arange(n - 1, -1, -1)) - (rows[:, 0] << n)

    def rice(self, n: int, k: int) -> np.ndarray:
        """n codes with parameter k."""
        if not n:
            return np.empty(0, np.int64)
        if k not in self.jumps:
            hop = np.full(len(self.ones) + 1, len(self.ones), np.intp)
            inside = int(np.searchsorted(self.ones, len(self.bits) - k - 1))
            hop[:inside] = self.before.take(self.ones[:inside] + (1 + k))
            far = hop
            for _ in range(STRIDE.bit_length() - 1):
                far = far.take(far)
            self.jumps[k] = hop, far
        hop, far = self.jumps[k]
        j, some, step = int(self.before[min(self.at, len(self.bits))]), [], far.item
        for _ in range(-(-n // STRIDE)):
            some.append(j)
            j = step(j)
        chain = np.empty((STRIDE, len(some)), np.intp)
        chain[0] = some
        for i in range(1, STRIDE):
            chain[i] = hop.take(chain[i - 1])
        chain = chain.T.ravel()[:n]
        if chain[-1] >= len(self.ones):
            raise FlacError("codes run past the frame")
        stop = self.ones.take(chain)
        zeros = np.concatenate([stop[:1] - self.at, stop[1:] - stop[:-1] - (1 + k)])
        self.at = int(stop[-1]) + 1 + k
        if self.at > len(self.bits):
            raise FlacError("codes run past the frame")
        after = stop + 1
        low = (self.words.take(after >> 3) << (after & 7) & 0xFFFFFFFF) >> (32 - k)
        u = zeros << k | low
        return (u >> 1) ^ -(u & 1)


def residual(bits: Bits, block: int, order: int) -> np.ndarray:
    method, log = bits.take(2), bits.take(4)
    if method > 1 or block % (1 << log) or block >> log < order:
        raise FlacError("bad residual header")
    wide, out = 5 if method else 4, []
    for i in range(1 << log):
        n, k = (block >> log) - order * (not i), bits.take(wide)
        if k == (1 << wide) - 1:
            raw = bits.take(5)
            out.append(bits.signed_many(n, raw) if raw else np.zeros(n, np.int64))
        else:
            out.append(bits.rice(n, k))
    return np.concatenate(out)


def restored(warm: np.ndarray, res: np.ndarray, order: int) -> np.ndarray:
    """Undo a fixed predictor: sum up as often as the order says."""
    heads, row = [], warm
    for _ in range(order):
        heads.append(row[0])
        row = np.diff(row)
    x = res
    for h in reversed(heads):
        x = np.cumsum(np.concatenate([[h], x]))
    return x


class Linear(NamedTuple):
    """A subframe under a linear predictor, whose sums need the samples before."""

    warm: np.ndarray
    res: np.ndarray
    c: np.ndarray
    shift: int


def predicted(parts: list[Linear]) -> list[np.ndarray]:
    """Undo the linear predictors of subframes of one order, all of them sample by sample together."""
    if not parts:
        return []
    rank = sorted(range(len(parts)), key=lambda i: -len(parts[i].res))
    sizes = np.array([len(parts[i].res) for i in rank])
    order, most = len(parts[0].c), int(sizes[0])
    x = np.zeros((order + most, len(parts)), np.int64)
    for column, i in enumerate(rank):
        x[:order, column], x[order : order + sizes[column], column] = parts[i].warm, parts[i].res
    c, shift = np.array([parts[i].c[::-1] for i in rank]).T.copy(), np.array([parts[i].shift for i in rank])
    alive = np.searchsorted(-sizes, -np.arange(most), side="left").tolist()
    for t, n in enumerate(alive):
        x[order + t, :n] += (c[:, :n] * x[t : t + order, :n]).sum(0) >> shift[:n]
    out: list[np.ndarray] = [x[:0, 0]] * len(parts)
    for column, i in enumerate(rank):
        out[i] = x[: order + sizes[column], column].copy()
    return out


def decode_frame(data: bytes, at: int, info: Info) -> tuple[int, np.ndarray | Linear, int]:
    """Frame number, samples (a linear predictor not yet undone) and the byte after a frame that begins at ``at``."""
    if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise FlacError("no frame sync")
    most = info.most or 2 * info.block * info.bps // 8 + 64
    window = data[at : at + most + 16]
    codes, shape = window[2], window[3]
    size = 1 if window[4] < 0x80 else 8 - (window[4] ^ 0xFF).bit_length()
    number = window[4] if size == 1 else window[4] & (0x7F >> size)
    for b in window[5 : 4 + size]:
        number = number << 6 | b & 0x3F
    p, code = 4 + size, codes >> 4
    if code == 6:
        block, p = window[p] + 1, p + 1
    elif code == 7:
        block, p = int.from_bytes(window[p : p + 2], "big") + 1, p + 2
    else:
        block = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(codes & 15, 0)
    if crc8(window[:p]) != window[p]:
        raise FlacError("header checksum")
    if shape >> 4:
        raise FlacError("more than one channel")
    bps = {0: info.bps, 1: 8, 2: 12, 4: 16}.get(shape >> 1 & 7)
    bits = Bits(window[p + 1 :])
    kind = bits.take(8)
    if kind & 0x81 or bps is None:
        raise FlacError("unsupported subframe")
    kind >>= 1
    if kind == 0:
        x = np.full(block, bits.signed(bps))
    elif kind == 1:
        x = bits.signed_many(block, bps)
    elif 8 <= kind <= 12:
        warm = bits.signed_many(kind - 8, bps) if kind > 8 else np.empty(0, np.int64)
        x = restored(warm, residual(bits, block, kind - 8), kind - 8)
    elif kind >= 32:
        order = kind - 31
        warm, precision, shift = bits.signed_many(order, bps), bits.take(4) + 1, bits.signed(5)
        c = bits.signed_many(order, precision)
        if shift < 0:
            raise FlacError("negative shift of a predictor")
        x = Linear(warm, residual(bits, block, order), c, shift)
    else:
        raise FlacError("reserved subframe type")
    end = p + 1 + -(-bits.at // 8)
    if crc16(window[:end]) != int.from_bytes(window[end : end + 2], "big"):
        raise FlacError("frame checksum")
    return number, x, at + end + 2


def decode_many(streams: list[bytes], sample: int = 0) -> list[tuple[list[Block], str | None]]:
    """For each stream its blocks from the one that holds ``sample`` on, and the error that ended it.

    Frame checksums are verified, and the MD5 of a stream read whole.  Linear predictors of all streams are undone together.
    """
    out: list[tuple[list[Block], str | None]] = []
    linear: dict[int, list[tuple[int, int, Linear]]] = {}
    infos: list[tuple[Info, bool] | None] = []
    for i, data in enumerate(streams):
        blocks, error, known = [], None, None
        try:
            info = read_info(data)
            at, done = info.first, 0
            for first, offset, _ in info.seeks:
                if first <= sample and first != (1 << 64) - 1:
                    at, done = info.first + offset, first
            known = info, done == 0 and sample == 0
            while at < len(data) and done < info.samples:
                _, x, end = decode_frame(data, at, info)
                n = len(x.warm) + len(x.res) if isinstance(x, Linear) else len(x)
                if done + n > sample:
                    if isinstance(x, Linear):
                        linear.setdefault(len(x.c), []).append((i, len(blocks), x))
                    blocks.append(Block(done, at, x))
                at, done = end, done + n
            if done != info.samples:
                raise FlacError("samples missing")
        except (FlacError, IndexError, ValueError) as e:
            error = str(e) or type(e).__name__
        out.append((blocks, error))
        infos.append(known)
    for parts in linear.values():
        for (i, j, _), x in zip(parts, predicted([p for *_, p in parts]), strict=True):
            out[i][0][j] = out[i][0][j]._replace(samples=x)
    for i, ((blocks, error), known) in enumerate(zip(out, infos, strict=True)):
        if error is None and known[1] and any(known[0].md5):
            md5 = hashlib.md5()
            for b in blocks:
                md5.update(b.samples.astype("<i2" if known[0].bps > 8 else np.int8).tobytes())
            if md5.digest() != known[0].md5:
                out[i] = blocks, "MD5 of the samples"
    return out


def decode(data: bytes, sample: int = 0) -> Iterator[Block]:
    """The blocks of one stream; its error is raised after the blocks before it."""
    blocks, error = decode_many([data], sample)[0]
    yield from blocks
    if error is not None:
        raise FlacError(error)

"""FLAC media columns: 8-bit mono streams, coded and decoded in numpy over many frames at a time.

A stream is STREAMINFO, a seek table with a point for every frame (sample offset, byte offset, samples) and frames of 1,152
samples or, at its end, fewer. Frames hold constant, verbatim, fixed-predictor or LPC subframes (predictors fitted to the frame) with Rice residuals,
whichever is smallest. Streams are written to the shared folder. The decoder reads them there, finds frames by the seek table, checks both
checksums and the frame's number, and gives PCM blocks with the offsets of their samples; any range of samples can be read by decoding just its frames.
It reads what this encoder writes: 8-bit mono in frames of at most 1,152 samples, one Rice partition, 4-bit parameters.

A sample is a payload byte minus 128. Nothing here is lossy. Null and empty texts are a payload of one block of spaces; texts of any length
are coded frame by frame; equal texts give equal streams; no rows give no rows. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batch as B
from . import exchange as X
from . import files

BLOCK, RATE, BITS = 192, 8000, 8
#: Samples of a frame; a stream's last one holds what is left, a multiple of BLOCK.
FRAME = 6 * BLOCK
#: The format's codes of frame sizes; others are written out.
SIZES = {192: 1, 576: 2, 1152: 3}
#: Coefficients of the fixed predictors by order: a fixed value of the format.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
ROWS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PART_BYTES = 2 << 20
#: Samples of a written PCM block.
PCM_BLOCK = 24 * BLOCK
PCM = "doc_id long, sample long, pcm binary, n_bytes long, media_bytes long, media_sha256 string, tail binary"
PCM_NAMES = [x.split()[0] for x in PCM.split(", ")]


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t.astype(np.uint16)


#: Polynomials of the header's and the frame's checksums: fixed values of the format.
CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of the byte slices, all slices at once."""
    out = np.zeros(len(starts), np.uint16)
    order = np.argsort(-lengths, kind="stable")
    s, n, acc = starts[order], lengths[order], np.zeros(len(starts), np.uint16)
    live = len(s)
    for j in range(int(n[0]) if len(n) else 0):
        while live and n[live - 1] <= j:
            live = int(np.searchsorted(-n[:live], -j, side="left"))
        x = data[s[:live] + j]
        a = acc[:live]
        acc[:live] = CRC8[a ^ x] if bits == 8 else (a << 8) ^ CRC16[(a >> 8) ^ x]
    out[order] = acc
    return out


def _numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: bytes (rows of 6) and how many."""
    size = 1 + (n >= 0x80) + (n >= 0x800) + (n >= 0x10000) + (n >= 0x200000) + (n >= 0x4000000)
    out = np.zeros((len(n), 6), np.uint8)
    for k in range(1, 7):
        own = size == k
        v = n[own]
        if k == 1:
            out[own, 0] = v
            continue
        out[own, 0] = (0xFF << (7 - k) & 0xFF) | (v >> (6 * (k - 1)))
        for j in range(1, k):
            out[own, j] = 0x80 | (v >> (6 * (k - 1 - j)) & 0x3F)
    return out, size


def _rice(resid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Folded residuals (rows, int64 places after the warm-up) to bits with the best of the parameters near their mean, and that parameter."""
    total = resid.sum(axis=1, dtype=np.int64)
    near = np.floor(np.log2(np.maximum(total / n, 1))).astype(np.int64)
    best, param = np.full(len(resid), 1 << 40), np.zeros(len(resid), np.int64)
    for step in (-1, 0, 1):
        k = np.clip(near + step, 0, 14)
        cost = (resid >> k[:, None].astype(resid.dtype)).sum(axis=1, dtype=np.int64) + n * (1 + k)
        better = cost < best
        best[better], param[better] = cost[better], k[better]
    return best, param


def _fold(r: np.ndarray) -> np.ndarray:
    return np.where(r < 0, -2 * r - 1, 2 * r)


#: Orders of fitted predictors that are tried, bits of a coefficient, and those after its point.
LPC, PRECISION, SHIFT = (1, 2, 3, 4), 10, 8


def fit_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of samples the order of the predictor that needs the fewest bits by its error, and its quantised coefficients (rows of max(LPC)).

    Levinson's recursion over the autocorrelations of all rows at once; samples are taken with a constant part, as the format has none.
    """
    f, n = x.shape
    w = x.astype(np.float64)
    top = max(LPC)
    r = np.stack([(w[:, : n - j] * w[:, j:]).sum(axis=1) for j in range(top + 1)], axis=1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((f, top)), r[:, 0].copy()
    order, coefs, least = np.full(f, LPC[0]), np.zeros((f, top), np.int64), np.full(f, np.inf)
    for m in range(1, top + 1):
        k = (r[:, m] - (a[:, : m - 1] * r[:, 1:m][:, ::-1]).sum(axis=1)) / err
        a[:, : m - 1] -= k[:, None] * a[:, : m - 1][:, ::-1]
        a[:, m - 1] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
        if m in LPC:
            bits = n / 2 * np.log2(err / n + 1e-9) + m * (BITS + PRECISION)
            better = bits < least
            q = np.clip(np.rint(a * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int64)
            least[better], order[better], coefs[better] = bits[better], m, q[better]
    coefs[np.arange(top) >= order[:, None]] = 0
    return order, coefs


def _predicted(x: np.ndarray, order: int, coefs: np.ndarray) -> np.ndarray:
    """What is left of the samples after the first ``order``."""
    out = np.zeros((len(x), x.shape[1] - order), np.int32)
    for j in range(order):
        out += x[:, order - 1 - j : x.shape[1] - 1 - j].astype(np.int32) * coefs[:, j : j + 1].astype(np.int32)
    return x[:, order:] - (out >> SHIFT)


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the samples (rows, int16), one after another, and their offsets: the smallest of constant, verbatim, fixed and fitted predictors."""
    f, width = x.shape
    kind, best, param = np.full(f, 1), np.full(f, 8 * width, np.int64), np.zeros(f, np.int64)  # by the format's subframe type
    u = np.zeros((f, width), np.int32)
    r = x.astype(np.int32)
    for o in range(3):
        if o:
            r = np.diff(r, axis=1)
        own = _fold(r)
        cost, k = _rice(own, width - o)
        cost += 8 * o + 10
        better = cost < best
        best[better], kind[better], param[better] = cost[better], 8 + o, k[better]
        u[better, o:] = own[better]
    order, coefs = fit_predictors(x)
    for o in LPC:
        rows = np.flatnonzero(order == o)
        own = _fold(_predicted(x[rows], o, coefs[rows]))
        cost, k = _rice(own, width - o)
        cost += 8 * o + 9 + PRECISION * o + 10
        better = cost < best[rows]
        at = rows[better]
        best[at], kind[at], param[at] = cost[better], 31 + o, k[better]
        u[at, o:] = own[better]
    flat = (x == x[:, :1]).all(axis=1)
    kind[flat], best[flat] = 0, 8
    code, size = _numbers(numbers)
    coded = SIZES.get(width, 7)
    extra = 2 * (coded == 7)  # bytes of a size that is written out
    header = 5 + size + extra
    body = (8 + best + 7) // 8
    length = header + body + 2
    offs = np.zeros(f + 1, np.int64)
    np.cumsum(length, out=offs[1:])
    bits = np.zeros(int(offs[-1]) * 8, np.uint8)
    base = (offs[:-1] + header) * 8

    def field(at: np.ndarray, values, width: int) -> None:
        values = np.broadcast_to(np.asarray(values), at.shape)
        for j in range(width):
            bits[at + j] = values >> (width - 1 - j) & 1

    for t in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == t)
        at = base[rows]
        field(at + 1, t, 6)
        at = at + 8
        if t < 2:
            n = width if t else 1
            field(at[:, None] + 8 * np.arange(n), x[rows][:, :n].astype(np.int64) & 0xFF, 8)
            continue
        o = t - 31 if t >= 32 else t - 8
        for j in range(o):
            field(at, x[rows, j].astype(np.int64) & 0xFF, 8)
            at = at + 8
        if t >= 32:
            field(at, PRECISION - 1, 4)
            field(at + 4, SHIFT, 5)
            at = at + 9
            for j in range(o):
                field(at, coefs[rows, j] & (1 << PRECISION) - 1, PRECISION)
                at = at + PRECISION
        k = param[rows]
        field(at + 6, k, 4)
        own = u[rows, o:].astype(np.int64)
        q = own >> k[:, None]
        n = q + 1 + k[:, None]
        begin = (at + 10)[:, None] + np.cumsum(n, axis=1) - n
        stop = begin + q
        bits[stop] = 1
        for kk in np.unique(k).tolist():
            some = k == kk
            for j in range(kk):
                bits[stop[some] + 1 + j] = own[some] >> (kk - 1 - j) & 1
    data = np.packbits(bits)
    at = offs[:-1]
    data[at], data[at + 1], data[at + 2], data[at + 3] = 0xFF, 0xF8, coded << 4 | 4, 0x02
    for j in range(int(size.max(initial=0))):
        own = size > j
        data[at[own] + 4 + j] = code[own, j]
    if extra:
        data[at + 4 + size], data[at + 5 + size] = width - 1 >> 8, width - 1 & 0xFF
    data[at + header - 1] = crc(data, at, header - 1, 8)
    sums = crc(data, at, length - 2, 16)
    data[offs[1:] - 2], data[offs[1:] - 1] = sums >> 8, sums & 0xFF
    return data, offs


class _Bits:
    """Bytes with, from each on, the 64 bits that begin there."""

    def __init__(self, data: np.ndarray):
        self.padded = np.concatenate([data, np.zeros(24, np.uint8)])
        self.wide = np.zeros(len(data) + 16, np.uint64)
        for j in range(8):
            self.wide |= self.padded[j : j + len(self.wide)].astype(np.uint64) << np.uint64(56 - 8 * j)

    def at(self, at: np.ndarray) -> np.ndarray:
        return self.wide[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n) -> np.ndarray:
        return (self.at(at) >> np.uint64(64 - n)).astype(np.int64) if n else np.zeros(len(at), np.int64)


def _header_ends(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where the frames' subframes begin, once their headers and both checksums are found right."""
    coded = np.full(len(starts), 7)
    for n, c in SIZES.items():
        coded[counts == n] = c
    if not ((padded[starts] == 0xFF) & (padded[starts + 1] == 0xF8) & (padded[starts + 2] == (coded << 4 | 4)) & (padded[starts + 3] == 0x02)).all():
        raise ValueError("a frame's header is not one of ours")
    code, size = _numbers(numbers)
    for j in range(6):
        own = size > j
        if (padded[starts[own] + 4 + j] != code[own, j]).any():
            raise ValueError("a frame has another number than its seek point")
    at = starts + 4 + size
    written = coded == 7
    if ((padded[at].astype(np.int64) << 8 | padded[at + 1]) != counts - 1)[written].any():
        raise ValueError("a frame has another size than its seek point")
    at = at + 2 * written
    if (crc(padded, starts, at - starts, 8) != padded[at]).any():
        raise ValueError("a frame's header doesn't match its checksum")
    if (crc(padded, starts, ends - starts - 2, 16) != (padded[ends - 2].astype(np.uint16) << 8 | padded[ends - 1])).any():
        raise ValueError("a frame doesn't match its checksum")
    return at + 1


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples of the frames at these bytes one after another, and offsets by frame. Raises ValueError if a checksum, a number or a size doesn't match.

    All frames are decoded side by side, those with most residuals first, so that the ones still going are always the first ones.
    """
    if not len(starts):
        return np.zeros(0, np.int8), np.zeros(1, np.int64)
    bits = _Bits(data)
    body = _header_ends(bits.padded, starts, ends, numbers, counts)
    kind = bits.padded[body] >> 1 & 0x3F
    if ((kind > 12) & (kind < 32) | (kind > 1) & (kind < 8)).any():
        raise ValueError("a subframe's type is reserved")
    # one value, or all values
    plain = np.flatnonzero(kind < 2)
    edge, place = B.spread(counts[plain])
    of = np.repeat(plain, counts[plain])
    parts = [bits.padded[body[of] + 1 + kind[of] * place].view(np.int8)]
    at = np.zeros(len(starts), np.int64)
    at[plain] = edge[:-1]
    order = np.where(kind >= 32, kind.astype(np.int64) - 31, kind.astype(np.int64) - 8)
    rows = np.flatnonzero(kind > 1)
    rows = rows[np.argsort(-(counts - order)[rows], kind="stable")]
    if len(rows):
        x = _decode_residuals(bits, body[rows] * 8 + 8, kind[rows] >= 32, order[rows], counts[rows], (ends[rows] - 2) * 8)
        at[rows] = len(parts[0]) + np.arange(len(rows)) * len(x)
        parts.append(np.ascontiguousarray(x.astype(np.int8).T).ravel())
    return B.gather(np.concatenate(parts), at, counts)


def _decode_residuals(bits: _Bits, at: np.ndarray, fitted: np.ndarray, order: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Samples (places by frames) of subframes with a predictor; frames in falling order of residuals."""
    take, f, top = bits.take, len(at), int(order.max())
    x = np.zeros((int(counts.max()), f), np.int32)
    at = at.copy()
    for j in range(top):
        own = np.flatnonzero(order > j)
        v = take(at[own], 8)
        x[j, own] = v - (v >> 7 << 8)
        at[own] += 8
    coefs, shift = np.zeros((max(top, 1), f), np.int32), np.zeros(f, np.int32)
    for o, c in FIXED.items():
        own = np.flatnonzero(~fitted & (order == o))
        for j, v in enumerate(c if len(own) else []):
            coefs[j, own] = v
    own = np.flatnonzero(fitted)
    precision = take(at[own], 4) + 1
    shift[own] = take(at[own] + 4, 5)
    at[own] += 9
    for p in np.unique(precision).tolist():
        some = own[precision == p]
        for j in range(top):
            more = some[order[some] > j]
            v = take(at[more], p)
            coefs[j, more] = v - (v >> (p - 1) << p)
            at[more] += p
    if (take(at, 6) != 0).any():
        raise ValueError("only residuals of one partition with 4-bit parameters are written")
    param = take(at + 6, 4)
    at += 10
    left = counts - order
    after, one = (63 - param).astype(np.uint64), np.uint64(1)
    live = f
    col = np.arange(f)
    for t in range(int(left[0])):
        if left[live - 1] <= t:
            live = int(np.searchsorted(-left, -t, side="left"))
        a = at[:live]
        w = bits.at(a)
        q = _LEADING[(w >> np.uint64(48)).view(np.int64)]
        if q.max() == 16:  # a long run of zeros
            many = np.flatnonzero(q == 16)
            q = q.copy()
            for i in many.tolist():
                p = int(a[i]) + 16
                while not take(np.array([p]), 1)[0]:
                    p += 1
                q[i] = p - int(a[i])
            rest = w << (np.minimum(q, 62).astype(np.uint64) + one)
            rest[many] = bits.at(a[many] + q[many] + 1)
        else:
            rest = w << (q.view(np.uint64) + one)
        u = q << param[:live]
        u |= (rest >> one >> after[:live]).view(np.int64)
        x[order[:live] + t, col[:live]] = (u >> 1) ^ -(u & 1)
        a += q
        a += 1
        a += param[:live]
    if (at > ends).any():
        raise ValueError("a frame's residuals run over its end")
    summed = ~fitted & (order < 3)
    for o in (1, 2):  # fixed predictors of low order are sums
        own = np.flatnonzero(summed & (order == o))
        if len(own):
            y = x[:, own]
            if o == 2:
                y[1] -= y[0]
                y[1:] = np.cumsum(y[1:], axis=0)
            x[:, own] = np.cumsum(y, axis=0)
    own = np.flatnonzero(~summed)
    if len(own):
        y, c, s, n = np.ascontiguousarray(x[:, own]), coefs[:, own], shift[own], order[own]
        size = counts[own]
        for t in range(1, len(y)):
            told = c[0] * y[t - 1]
            for j in range(1, min(t, top)):
                told += c[j] * y[t - 1 - j]
            told >>= s
            y[t] += told if t >= top else np.where(n <= t, told, 0)
            if t % 64 == 0:
                y[t] *= size > t  # frames that have ended stay at nothing
        x[:, own] = y
    return x


_LEADING = np.full(1 << 16, 16, np.int64)
for _z in range(16):
    _LEADING[1 << (15 - _z) : 1 << (16 - _z)] = _z


def encode_streams(payloads: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for each payload; lengths are multiples of BLOCK."""
    lengths = np.diff(offsets)
    per = -(-lengths // FRAME)
    first, place = B.spread(per)
    of = np.repeat(np.arange(len(per)), per)
    counts = np.minimum(lengths[of] - place * FRAME, FRAME)
    x = payloads.astype(np.int16) - 128
    begin = offsets[:-1][of] + place * FRAME
    parts, at, sizes, total = [], np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), 0
    for n in np.unique(counts).tolist():  # frames of one size together
        rows = np.flatnonzero(counts == n)
        made, edge = encode_frames(x[begin[rows][:, None] + np.arange(n)], place[rows])
        parts.append(made)
        at[rows], sizes[rows] = edge[:-1] + total, np.diff(edge)
        total += len(made)
    data, offs = B.gather(np.concatenate(parts) if parts else np.zeros(0, np.uint8), at, sizes)
    raw, out = data.tobytes(), []
    pcm = x.astype(np.int8).tobytes()
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = b - a
        info = np.array([FRAME, FRAME], ">u2").tobytes() + int(sizes[a:b].min()).to_bytes(3, "big") + int(sizes[a:b].max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | ((BITS - 1) << 36) | int(lengths[i])).to_bytes(8, "big") + hashlib.md5(pcm[offsets[i] : offsets[i + 1]], usedforsecurity=False).digest()
        points = np.zeros(n, POINT)
        points["sample"], points["byte"], points["samples"] = np.arange(n) * FRAME, offs[a:b] - offs[a], counts[a:b]
        out.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + (18 * n).to_bytes(3, "big") + points.tobytes() + raw[offs[a] : offs[b]])
    return out


#: A seek point: a fixed layout of the format.
POINT = np.dtype([("sample", ">u8"), ("byte", ">u8"), ("samples", ">u2")])


class Stream:
    """A stored stream's header: samples, and the byte offsets of its frames."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[:4]) != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, None
        while not last:
            last, kind, n = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
            block = raw[at + 4 : at + 4 + n]
            if kind == 0:
                word = int.from_bytes(block[10:18], "big")
                self.samples, self.md5 = word & (1 << 36) - 1, bytes(block[18:34])
                if (word >> 36 & 31) + 1 != BITS or (word >> 41 & 7) != 0:
                    raise ValueError("only 8-bit mono streams are written")
            elif kind == 3:
                self.points = np.frombuffer(block, POINT)
            at += 4 + n
        self.start = at
        self.begins, self.counts = at + self.points["byte"].astype(np.int64), self.points["samples"].astype(np.int64)
        self.ends = np.append(self.begins[1:], len(raw))


def _frames(heads: list[Stream], blobs: list[bytes], spans: list[tuple[int, int]]):
    """Begins, ends, numbers and sample counts of some frames of each stream, as places in all streams one after another."""
    at = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    cols = [[np.zeros(0, np.int64)] for _ in range(4)]
    for h, s, (i, j) in zip(heads, at.tolist(), spans, strict=False):
        for col, v in zip(cols, (h.begins[i:j] + s, h.ends[i:j] + s, np.arange(i, j), h.counts[i:j]), strict=True):
            col.append(v)
    return np.frombuffer(b"".join(blobs), np.uint8), *map(np.concatenate, cols)


def decode_streams(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The PCM of all streams, one after another, and offsets in samples."""
    heads = [Stream(memoryview(b)) for b in blobs]
    x, offs = decode_frames(*_frames(heads, blobs, [(0, len(h.begins)) for h in heads]))
    return x, offs[np.concatenate([[0], np.cumsum([len(h.begins) for h in heads])]).astype(np.int64)]


def read_samples(blobs: list[bytes], lo: list[int], hi: list[int]) -> list[np.ndarray]:
    """Samples lo to hi of each stream, by seeking: only the frames that hold them are decoded."""
    heads = [Stream(memoryview(b)) for b in blobs]
    spans = [(a // FRAME, -(-b // FRAME)) for a, b in zip(lo, hi, strict=True)]
    x, offs = decode_frames(*_frames(heads, blobs, spans))
    first = np.concatenate([[0], np.cumsum([j - i for i, j in spans])]).astype(np.int64)
    return [x[offs[k] + a - i * FRAME : offs[k] + b - i * FRAME] for k, (i, _), a, b in zip(first[:-1].tolist(), spans, lo, hi, strict=True)]


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each with spaces up to a positive multiple of BLOCK, and offsets."""
    n = np.diff(offsets)
    padded = np.maximum(-(-n // BLOCK), 1) * BLOCK
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(padded, out=offs[1:])
    out = np.full(int(offs[-1]), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(offs[:-1] - offsets[:-1], n)] = data
    return out, offs


def media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``' id, its payload's length and the FLAC stream that stores it: doc_id, n_bytes, media."""
    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text")

    def run(batches):
        for ids, data, offs in _parts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offs)), pa.array(encode_streams(*payloads(data, offs)), pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _parts(batches):
    for x in batches:
        sizes = np.asarray(pc.binary_length(x.column(1)).fill_null(0)).astype(np.int64)
        at = X.cuts(sizes + FRAME, PART_BYTES)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            part = x.slice(lo, hi - lo)
            yield part.column(0), *B.flat(part.column(1))
            B.trim()


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The streams of ``media``, written to the shared folder and read back from there."""
    at = files.fresh(X.shared_dir(docs.sparkSession), "flac")
    media(docs, doc_id, text).write.mode("overwrite").option("compression", "zstd").parquet(at)
    return docs.sparkSession.read.parquet(at)


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """What the streams decode to (PCM): a row for each block of at most PCM_BLOCK samples, with the offset of its first sample in the stream.

    Every frame's checksums and number, and every stream's MD5, are checked. The blocks of a stream follow one another in order;
    with the first come the lengths and the digest of the stored bytes, and the stream's last 16 samples, read by seeking.
    """

    def run(batches):
        for x in batches:
            sizes = np.asarray(pc.binary_length(x.column("media")).fill_null(0)).astype(np.int64)
            at = X.cuts(sizes, PART_BYTES)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                yield from _blocks(x.slice(lo, hi - lo)).to_batches()
                B.trim()

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, PCM)


def _blocks(x: pa.RecordBatch) -> pa.Table:
    blobs = x.column("media").to_pylist()
    pcm, offs = decode_streams(blobs)
    signed = pcm.tobytes()
    for blob, a, b in zip(blobs, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if Stream(memoryview(blob)).md5 != hashlib.md5(signed[a:b], usedforsecurity=False).digest():
            raise ValueError("a stream doesn't match its MD5")
    n = np.diff(offs)
    tails = read_samples(blobs, (n - 16).tolist(), n.tolist())
    per = -(-n // PCM_BLOCK)
    first, place = B.spread(per)
    of = np.repeat(np.arange(len(n)), per)
    start = place * PCM_BLOCK
    cut = np.append(offs[:-1][of] + start, offs[-1])
    head = place == 0
    only = lambda values, kind: pa.array(values, kind).take(pa.array(np.where(head, of, 0), mask=~head))
    return pa.table(
        [x.column("doc_id").take(pa.array(of)), pa.array(start), B.from_parts(pcm.view(np.uint8), cut).cast(pa.binary()), only(x.column("n_bytes"), pa.int64()), only([len(b) for b in blobs], pa.int64()),
         only([hashlib.sha256(b).hexdigest() for b in blobs], pa.string()), only([t.tobytes() for t in tails], pa.binary())],
        PCM_NAMES,
    )


def write_pcm(stored: DataFrame, folder: str) -> None:
    """Writes the blocks of ``pcm_blocks``, each stream's together and in order; ``read_pcm`` finds samples by their offsets."""
    pcm_blocks(stored).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read_pcm(spark, folder: str, lo: int, hi: int) -> DataFrame:
    """(doc_id, sample, pcm): samples ``lo`` to ``hi`` of every written stream; of others than their blocks only the offsets are read."""
    rows = spark.read.parquet(folder).where((F.col("sample") < hi) & (F.col("sample") + PCM_BLOCK > lo))
    skip = F.greatest(F.lit(lo) - F.col("sample"), F.lit(0))
    return rows.select("doc_id", (F.col("sample") + skip).alias("sample"), F.substring("pcm", (skip + 1).cast("int"), (F.lit(hi) - F.col("sample") - skip).cast("int")).alias("pcm")).where(F.octet_length("pcm") > 0)


def digest(blocks: DataFrame) -> DataFrame:
    """One row for each stream of ``pcm_blocks``, from its blocks as they come; one block is held at a time."""

    def run(batches):
        now = None
        for x in batches:
            out = []
            for i, start, pcm, n, size, sha, tail in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if start == 0:
                    if now is not None:
                        out.append(now.row())
                    now = _Digest(i, n, size, sha, tail)
                now.add(np.frombuffer(pcm, np.int8))
            if out:
                yield _rows(out)
        if now is not None:
            yield _rows([now.row()])

    return blocks.mapInArrow(run, ROWS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in ROWS.split(", ")])


class _Digest:
    """A stream's digests and features (peak, energy, sign changes and mean step, in whole numbers), block by block."""

    def __init__(self, doc_id, n_bytes, size, sha, tail):
        self.head, self.size, self.sha, self.tail = (doc_id, n_bytes), size, sha, tail
        self.raw, self.n, self.last = hashlib.sha256(), 0, None
        self.peak = self.energy = self.flips = self.steps = 0

    def add(self, pcm: np.ndarray) -> None:
        x = pcm.astype(np.int16)
        self.raw.update((x + 128).astype(np.uint8).tobytes())
        near = x if self.last is None else np.concatenate([self.last, x])
        self.peak = max(self.peak, int(np.abs(x).max(initial=0)))
        self.energy += int((x.astype(np.int32) * x).sum(dtype=np.int64))
        self.flips += int(((near[1:] < 0) != (near[:-1] < 0)).sum())
        self.steps += int(np.abs(np.diff(near)).sum(dtype=np.int64))
        self.n, self.last = self.n + len(x), x[-1:]

    def row(self) -> tuple:
        tail = (np.frombuffer(self.tail, np.int8).astype(np.int16) + 128).astype(np.uint8).tobytes()
        said = f"peak={self.peak};energy={self.energy};flips={self.flips};step={self.steps * 1000 // self.n}"
        return (*self.head, self.n, self.raw.hexdigest(), zlib.crc32(tail), self.size, self.sha, said)

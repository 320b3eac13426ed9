"""Lossless WebP (VP8L): a decoder for every feature of the format, and a writer that codes images by their content.

The decoder reads prefix codes (simple and normal), meta prefix images, back-references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms. Images with one group of codes are walked
through symbol by symbol for their places alone; values, copies and cache hits are then worked out for all pixels at once.

The writer uses a palette where there are few colours, the predictor where rows repeat the row above, back-references
where runs of pixels repeat, and the colour cache where single pixels do; small images share one set of prefix codes,
larger ones get their own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: The 120 near places of short distance codes: nearer first, then by |x|, the right side before the left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
SIDE = 1 << 14
#: Pixels in a row of a stored payload, which makes 64 bytes; a longer payload than SIDE rows goes into several images.
ROW = 16
#: Numbers of 15 bits, read from their other end.
REVERSED = sum(((np.arange(1 << 15) >> k) & 1) << (14 - k) for k in range(15))


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        return x


class Code:
    """A canonical prefix code, from its symbols' lengths."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else -1
        self.width = 0
        self.lengths, self.symbols = np.zeros(1, dtype=np.int64), np.array([max(self.single, 0)])
        if len(used) < 2:
            if not len(used):
                self.single = 0
            self.finish()
            return
        used = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[used].astype(np.int64)
        if int((1 << (15 - n)).sum()) != 1 << 15:
            raise ValueError("a prefix code isn't complete")
        self.width = int(n[-1])
        # by the first bits read as a number, highest first, symbols fill the table in order
        place = REVERSED[: 1 << self.width] >> (15 - self.width)
        each = 1 << (self.width - n)
        self.lengths, self.symbols = np.repeat(n, each)[place], np.repeat(used, each)[place]
        self.finish()

    def finish(self) -> None:
        self.mask = (1 << self.width) - 1
        #: Bits of the symbol: of a green code, 16 more for back-references and 32 more for cache places.
        self.steps = (self.lengths + 16 * (self.symbols >= 256) + 16 * (self.symbols >= 280)).astype(np.uint8).tobytes()

    def read(self, bits: Bits) -> int:
        if self.single >= 0:
            return self.single
        k = bits.peek(self.width)
        bits.at += self.steps[k] & 15
        return int(self.symbols[k])


@lru_cache(64)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, dtype=np.uint8))


def read_code(bits: Bits, symbols: int) -> Code:
    lengths = np.zeros(symbols, dtype=np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for n in (8 if wide else 1, *([8] if two else [])):
            s = bits.read(n)
            if s >= symbols:
                raise ValueError("a symbol is out of range")
            lengths[s] = 1
        return _code(lengths.tobytes())
    order = np.zeros(19, dtype=np.uint8)
    for k in range(4 + bits.read(4)):
        order[LENGTH_ORDER[k]] = bits.read(3)
    most = symbols if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    of = _code(order.tobytes())
    if 0 <= of.single < 16:  # takes no bits
        lengths[:most] = of.single
        return _code(lengths.tobytes())
    data, place, table, steps, mask = bits.data, bits.at, of.symbols.tolist(), of.steps, of.mask
    out, before = bytearray(), 8
    while len(out) < symbols and most > 0:
        most -= 1
        i = place >> 3
        x = int.from_bytes(data[i : i + 4], "little") >> (place & 7)  # 25 bits or more; a symbol takes 14 at most
        s, n = table[x & mask], steps[x & mask]
        x >>= n
        if s < 16:
            out.append(s)
            before = s or before
        elif s == 16:
            out += bytes([before]) * (3 + (x & 3))
            n += 2
        elif s == 17:
            out += bytes(3 + (x & 7))
            n += 3
        else:
            out += bytes(11 + (x & 127))
            n += 7
        place += n
    if len(out) > symbols:
        raise ValueError("code lengths run over")
    bits.at = place
    if place > 8 * len(data):
        raise ValueError("the image ends early")
    return _code(bytes(out) + bytes(symbols - len(out)))


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


#: Groups of codes read lately, by how their text begins: cache bits, place in the byte, first 17 bytes -> bits, bytes, rest, codes.
_GROUPS: dict[tuple[int, int, int, bytes], tuple[int, bytes, int, list[Code]]] = {}


def _group(bits: Bits, cache: int) -> list[Code]:
    by, off = bits.at >> 3, bits.at & 7
    key = (cache, off, bits.data[by] >> off if by < len(bits.data) else 0, bits.data[by + 1 : by + 17])
    if hit := _GROUPS.get(key):
        n, text, rest, codes = hit
        end, tail = by + 1 + len(text), (bits.at + n) & 7
        if bits.data[by + 1 : end] == text and (not tail or end < len(bits.data) and bits.data[end] & ((1 << tail) - 1) == rest):
            bits.at += n
            return codes
    start = bits.at
    codes = [read_code(bits, n) for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40)]
    end, tail = bits.at >> 3, bits.at & 7
    if end - by > 17 and end + (tail > 0) <= len(bits.data):
        if len(_GROUPS) > 16:
            _GROUPS.clear()
        _GROUPS[key] = (bits.at - start, bits.data[by + 1 : end], bits.data[end] & ((1 << tail) - 1) if tail else 0, codes)
    return codes


#: Bytes of an image whose symbols are walked through together.
BLOCK = 1 << 15


def _tokens(bits: Bits, codes: list[Code], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, pixel, length, distance symbol's value) of each symbol of an image with one group of codes; kind is 0 for a
    literal pixel, 1 for a back-reference, else 2 plus the place in the cache. Moves bits to the image's end."""
    green, red, blue, alpha, dist = codes
    if not any(c.width for c in codes[:4]) and green.single < 256:  # one pixel all over, which takes no bits
        pixel = alpha.single << 24 | red.single << 16 | green.single << 8 | blue.single
        return np.zeros(total, dtype=np.int64), np.full(total, pixel), np.ones(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
    g_steps, r_steps, b_steps, a_steps = (c.steps for c in codes[:4])
    g_mask, r_mask, b_mask, a_mask = (c.mask for c in codes[:4])
    parts, done = [], 0
    while done < total:
        by, at = bits.at >> 3, bits.at & 7
        if by >= len(bits.data):
            raise ValueError("the image ends early")
        raw = bits.data[by : by + BLOCK + 32]
        stop = 8 * (BLOCK if by + len(raw) < len(bits.data) else len(raw))  # a symbol takes less than 9 bytes
        raw += bytes(32)  # beyond the end, bits are 0
        words = np.ndarray(len(raw) - 8, dtype="<u8", buffer=raw, strides=(1,)).tolist()  # 64 bits from each byte
        if sum(c.width for c in codes[:4]) > 57:
            words = [x | y << 64 for x, y in zip(words, words[8:], strict=False)]
        seen, back, sizes, fars = [], [], [], []
        while done < total and at < stop:
            seen.append(at)
            x = words[at >> 3] >> (at & 7)
            n = g_steps[x & g_mask]
            if n < 16:
                n += r_steps[x >> n & r_mask]
                n += b_steps[x >> n & b_mask]
                at += n + a_steps[x >> n & a_mask]
                done += 1
            elif n >= 32:
                at += n - 32
                done += 1
            else:
                back.append(len(seen) - 1)
                s = int(green.symbols[x & g_mask]) - 256
                bits.at = 8 * by + at + n - 16
                sizes.append(_value(bits, s))
                fars.append(_value(bits, dist.read(bits)))
                at = bits.at - 8 * by
                done += sizes[-1]
        bits.at = 8 * by + at
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
        w = b[:-2] | b[1:-1] << 8 | b[2:] << 16
        p = np.array(seen, dtype=np.int64)
        values = []
        for code in codes[:4]:
            k = w[p >> 3] >> (p & 7) & code.mask
            values.append(code.symbols[k])
            p += code.lengths[k]
        s, r, x, y = values
        size, far = np.ones(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
        size[back], far[back] = sizes, fars
        parts.append((np.where(s < 256, 0, np.where(s < 280, 1, s - 280 + 2)), y << 24 | r << 16 | s << 8 | x, size, far))
    if done > total:
        raise ValueError("a back-reference leaves the image")
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _distance(value: int, width: int) -> int:
    if value > 120:
        return value - 120
    x, y = NEAR[value - 1]
    return max(1, x + y * width)


def _one_group(bits: Bits, codes: list[Code], cache: int, width: int, height: int) -> np.ndarray:
    kind, pixel, size, far = _tokens(bits, codes, width * height)
    if not kind.any():
        return pixel.astype(np.uint32).reshape(height, width)
    n, starts = width * height, np.cumsum(size) - size
    source, value = np.arange(n + 1), np.zeros(n + 1, dtype=np.uint32)  # the pixel that a pixel is copied from; the last one is an empty cache place
    value[starts[kind == 0]] = pixel[kind == 0]
    for k in np.flatnonzero(kind == 1).tolist():
        at, d = int(starts[k]), _distance(int(far[k]), width)
        if d > at:
            raise ValueError("a back-reference leaves the image")
        source[at : at + int(size[k])] -= d
    hits = starts[kind > 1]
    if len(hits):
        # a cache place holds the last pixel that belongs there, whatever brought it; where a pixel belongs is known before its value
        slot = (value * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache)
        slot[hits] = kind[kind > 1] - 2
        slot = slot[_origins(source)][:n].astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        same = slot[order[1:]] == slot[order[:-1]]
        before = np.full(n, n)
        before[order[1:][same]] = order[:-1][same]
        source[hits] = before[hits]
    return value[_origins(source)[:n]].reshape(height, width)


def _origins(source: np.ndarray) -> np.ndarray:
    """Where each pixel's chain of sources ends."""
    while True:
        further = source[source]
        if (further == source).all():
            return source
        source = further


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels as unsigned 32-bit numbers."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("the colour cache is too large")
    meta, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = (_image(bits, -(-width >> shift), -(-height >> shift), False) >> np.uint32(8)) & np.uint32(0xFFFF)
    groups = [_group(bits, cache) for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    if len(groups) == 1:
        return _one_group(bits, groups[0], cache, width, height)
    out, at, total = [0] * (width * height), 0, width * height
    held = [0] * (1 << cache) if cache else []
    done = 0
    while at < total:
        green, red, blue, alpha, distance = groups[int(meta[(at // width) >> shift, (at % width) >> shift])] if meta is not None else groups[0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _value(bits, s - 256)
            d = _distance(_value(bits, distance.read(bits)), width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + n):
                out[k] = out[k - d]
            at += n
        else:
            for p in out[done:at]:
                held[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache)] = p
            done = at
            out[at] = held[s - 280]
            at += 1
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
    return np.array(out, dtype=np.uint32).reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(height, width, 4): alpha, red, green, blue."""
    return argb.astype(">u4").view(np.uint8).reshape(*argb.shape, 4).copy()


def _unpredict(pixels: np.ndarray, modes: np.ndarray, shift: int) -> None:
    """Adds to each pixel what its block's mode predicts from the pixels before it; in place."""
    height, width, _ = pixels.shape
    p = pixels.astype(np.int32)
    p[0, 0, 0] = (p[0, 0, 0] + 255) & 255
    p[0] = np.cumsum(p[0], axis=0) & 255
    if (modes == 2).all():
        np.cumsum(p, axis=0, out=p)
        pixels[:] = p & 255
        return
    half = lambda a, b: (a + b) >> 1
    for y in range(1, height):
        up, row = p[y - 1], p[y]
        row[0] = (row[0] + up[0]) & 255
        x = 1
        while x < width:
            mode, end = int(modes[y >> shift, x >> shift]), min(width, ((x >> shift) + 1) << shift)
            if mode in (0, 2, 3, 4, 8, 9) and not (mode in (3, 9) and end == width):
                t, tl = up[x:end], up[x - 1 : end - 1]
                if mode == 0:
                    row[x:end, 0] += 255
                elif mode in (2, 4):
                    row[x:end] += t if mode == 2 else tl
                elif mode == 8:
                    row[x:end] += half(tl, t)
                else:
                    tr = up[x + 1 : end + 1]
                    row[x:end] += tr if mode == 3 else half(t, tr)
                row[x:end] &= 255
            elif mode == 1:
                row[x:end] = (np.cumsum(row[x:end], axis=0) + row[x - 1]) & 255
            else:
                for i in range(x, end):
                    left, t, tl = row[i - 1], up[i], up[i - 1]
                    tr = up[i + 1] if i + 1 < width else row[0]
                    if mode == 3:
                        q = tr
                    elif mode == 5:
                        q = half(half(left, tr), t)
                    elif mode == 6:
                        q = half(left, tl)
                    elif mode == 7:
                        q = half(left, t)
                    elif mode == 9:
                        q = half(t, tr)
                    elif mode == 10:
                        q = half(half(left, tl), half(t, tr))
                    elif mode == 11:
                        q = left if np.abs(t - tl).sum() < np.abs(left - tl).sum() else t
                    elif mode == 12:
                        q = np.clip(left + t - tl, 0, 255)
                    elif mode == 13:
                        a = half(left, t)
                        q = np.clip(a + np.trunc((a - tl) / 2).astype(np.int32), 0, 255)
                    else:
                        q = np.array([255, 0, 0, 0])
                    row[i] = (row[i] + q) & 255
            x = end
    pixels[:] = p


def _uncross(pixels: np.ndarray, elements: np.ndarray, shift: int) -> None:
    """Adds back what green gave to red and blue, and red to blue; in place."""
    height, width, _ = pixels.shape
    e = np.repeat(np.repeat(elements, 1 << shift, axis=0)[:height], 1 << shift, axis=1)[:, :width].view(np.int8).astype(np.int32)
    signed = lambda c: c.astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(pixels[..., 2])
    red = pixels[..., 1] + (e[..., 3] * green >> 5)
    blue = pixels[..., 3] + (e[..., 2] * green >> 5) + (e[..., 1] * signed(red & 255) >> 5)
    pixels[..., 1], pixels[..., 3] = red & 255, blue & 255


def decode_stream(data: bytes) -> np.ndarray:
    """A VP8L stream's pixels: (height, width, 4) of red, green, blue, alpha."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height, alpha_used = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, seen, w = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform repeats")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            shift = bits.read(3) + 2
            transforms.append((kind, shift, _image(bits, -(-w >> shift), -(-height >> shift), False), w))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colors = np.cumsum(_channels(_image(bits, n, 1, False))[0], axis=0, dtype=np.uint8)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, shift, colors, w))
            w = -(-w >> shift)
        else:
            transforms.append((kind, 0, None, w))
    argb = _image(bits, w, height, True)
    if not transforms:
        pixels = np.ascontiguousarray(argb).view(np.uint8).reshape(height, width, 4)
        out = pixels[..., [2, 1, 0, 3]]
    else:
        pixels = _channels(argb)
        for kind, shift, extra, w in reversed(transforms):
            if kind == PREDICTOR:
                _unpredict(pixels, (extra >> np.uint32(8)) & np.uint32(15), shift)
            elif kind == CROSS_COLOR:
                _uncross(pixels, _channels(extra), shift)
            elif kind == SUBTRACT_GREEN:
                pixels[..., 1] += pixels[..., 2]
                pixels[..., 3] += pixels[..., 2]
            else:
                at, each = np.arange(w), 8 >> shift
                index = (pixels[:, at >> shift, 2] >> ((at & ((1 << shift) - 1)) * each).astype(np.uint8)) & ((1 << each) - 1)
                table = np.zeros((256, 4), dtype=np.uint8)
                table[: len(extra)] = extra
                pixels = table[index]
        out = pixels[..., [1, 2, 3, 0]]
    if not alpha_used:
        out = out.copy()
        out[..., 3] = 255
    return out


def decode(data: bytes) -> np.ndarray:
    """A WebP file's pixels, by its first lossless image: (height, width, 4) of red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def contained(stream: bytes) -> bytes:
    """The stream as a WebP file."""
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


class Writer:
    """Bits, least significant first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, x: int, n: int) -> Writer:
        self.value |= x << self.n
        self.n += n
        return self


def _lengths(weight: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code for symbols of these weights (0: none), at most `most`; one symbol alone has length 1."""
    used = np.flatnonzero(weight)
    out = np.zeros(len(weight), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    w = weight[used].astype(np.int64)
    while True:
        by = np.argsort(w, kind="stable")
        n, leaves = len(used), w[by].tolist()
        joined: list[int] = []  # weights of joined nodes, which never fall
        above, i, j = [0] * (2 * n - 1), 0, 0
        for k in range(n - 1):
            total = 0
            for _ in range(2):
                if i < n and (j >= k or leaves[i] <= joined[j]):
                    total += leaves[i]
                    above[i] = n + k
                    i += 1
                else:
                    total += joined[j]
                    above[n + j] = n + k
                    j += 1
            joined.append(total)
        level = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            level[k] = level[above[k]] + 1
        if max(level) <= most:
            out[used[by]] = level[:n]
            return out
        w = np.maximum(w >> 1, 1) + (w.max() >> most)  # flatter weights give shorter codes


def _words(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code word, first bit lowest."""
    out, used = np.zeros(len(lengths), dtype=np.int64), np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    room = 1 << (15 - lengths[used].astype(np.int64))
    out[used] = REVERSED[np.cumsum(room) - room]
    return out


def _put_code(w: Writer, lengths: np.ndarray) -> np.ndarray:
    """Writes a code; returns the lengths that symbols take (none where there is one symbol)."""
    used = np.flatnonzero(lengths)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        k = int(used[0]) if len(used) else 0
        w.put(1, 1).put(0, 1).put(int(k > 1), 1).put(k, 8 if k > 1 else 1)
        return np.zeros(len(lengths), dtype=np.uint8)
    runs: list[tuple[int, int, int]] = []  # symbol of the code-length code, extra value, extra bits
    values, before = lengths[: int(used[-1]) + 1], 8
    starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    for v, n in zip(values[starts].tolist(), np.diff(starts, append=len(values)).tolist(), strict=True):
        left = n
        if v:
            if v != before:
                runs.append((v, 0, 0))
                before, left = v, left - 1
            while left >= 3:
                m = min(left, 6)
                runs.append((16, m - 3, 2))
                left -= m
        else:
            while left >= 3:
                m = min(left, 138)
                runs.append((17, m - 3, 3) if m < 11 else (18, m - 11, 7))
                left -= m
        runs += [(v, 0, 0)] * left
    lengths_of = _lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    word, of = _words(lengths_of).tolist(), lengths_of.tolist()
    last = max(k for k in range(19) if of[LENGTH_ORDER[k]])
    count = max(last + 1, 4)
    w.put(0, 1).put(count - 4, 4)
    for k in range(count):
        w.put(of[LENGTH_ORDER[k]], 3)
    w.put(1, 1)
    size = max((len(runs) - 2).bit_length(), 2)
    size += size & 1
    w.put((size - 2) // 2, 3).put(len(runs) - 2, size)
    if np.count_nonzero(lengths_of) == 1:  # takes no bits
        of = [0] * 19
    rest = Writer()
    for s, x, n in runs:
        rest.put(word[s] | x << of[s], of[s] + n)
    w.put(rest.value, rest.n)
    return lengths if len(used) > 1 else np.zeros(len(lengths), dtype=np.uint8)


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of values from 1."""
    x = v - 1
    high = np.maximum(np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1, 0)
    second = (x >> np.maximum(high - 1, 0)) & 1
    bits = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + second), np.where(x < 4, 0, x & ((1 << np.maximum(bits, 0)) - 1)), bits


#: Pixels up to which images share one set of codes.
SHARED = 1024
#: A run of so many pixels that repeats becomes a back-reference; places of the colour cache, as bits.
RUN, CACHE = 4, 10


@lru_cache(2)
def _shared(cache: int) -> tuple[int, int, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(bits, how many, lengths, words) of the codes for small images: by rule, spaces and small letters are common, other
    printable characters less so, all other bytes rare."""
    byte = np.full(256, 1)
    byte[33:127] = 6
    byte[97:123] = 100
    byte[[0, 32, 97, 101, 105, 110, 111, 114, 115, 116]] = [120, 400, 200, 300, 200, 200, 200, 200, 200, 250]
    lengths = [_lengths(np.concatenate((byte, np.full(24, 2), np.full(1 << cache if cache else 0, 1)))), *[_lengths(byte)] * 3, _lengths(np.ones(40, dtype=np.int64))]
    w = Writer()
    taken = tuple(_put_code(w, x) for x in lengths)
    return w.value, w.n, taken, tuple(_words(x) for x in lengths)


def _repeats(p: np.ndarray) -> list[tuple[int, int, int]]:
    """(at, length, distance) of runs of RUN pixels and more that came before; not overlapping, in order."""
    n = len(p) - RUN + 1
    if n < 2:
        return []
    h = p[:n].astype(np.uint64)
    for k in range(1, RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + p[k : k + n]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return []
    before = np.full(n, -1, dtype=np.int64)
    before[order[same + 1]] = order[same]
    places, out, at = np.flatnonzero(before >= 0), [], 0
    while True:
        k = int(np.searchsorted(places, at))
        if k == len(places):
            return out
        i = int(places[k])
        j = int(before[i])
        n = min(len(p) - i, 4096)
        differ = np.flatnonzero(p[i : i + n] != p[j : j + n])
        n = int(differ[0]) if len(differ) else n
        if n >= RUN and i - j < 1 << 20:
            out.append((i, n, i - j))
            at = i + n
        else:
            at = i + 1


def _distinct(pixels: np.ndarray) -> np.ndarray:
    x = np.sort(pixels, axis=None)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _put_image(w: Writer, pixels: np.ndarray, main: bool, text: bool = False) -> bytes | None:
    """Writes an image's codes and pixels (ARGB, row by row), the main one's last part as bytes that begin with w's open bits.
    text: the pixels are the payload's own, so that a small image may use the shared codes."""
    p = pixels.ravel().astype(np.uint32)
    found = _repeats(p) if main else []
    single = np.ones(len(p), dtype=bool)
    for at, n, _ in found:
        single[at : at + n] = False
    cache, place = 0, None
    if main and len(p) > SHARED and len(_distinct(p)) < 0.5 * len(p):
        cache = CACHE
        slots = ((np.uint64(0x1E35A7BD) * p.astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE)).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        hit = np.flatnonzero((slots[order[1:]] == slots[order[:-1]]) & (p[order[1:]] == p[order[:-1]]))
        place = np.full(len(p), -1, dtype=np.int64)  # the cache holds the last pixel of each place, whatever brought it
        place[order[hit + 1]] = slots[order[hit + 1]]
    w.put(int(cache > 0), 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(0, 1)  # one group of codes
    starts = np.flatnonzero(single)
    back, d_sym = np.zeros(len(starts), dtype=bool), np.empty(0, dtype=np.int64)
    if found:
        runs, size, far = np.array(found, dtype=np.int64).T
        starts = np.sort(np.concatenate((starts, runs)))
        back = np.zeros(len(starts), dtype=bool)
        back[np.searchsorted(starts, runs)] = True
    cached = (place[starts] >= 0) & ~back if cache else np.zeros(len(starts), dtype=bool)
    q = p[starts].astype(np.int64)
    symbols = [(q >> 8) & 255, (q >> 16) & 255, q & 255, q >> 24]
    if found:
        n_sym, n_extra, n_bits = _prefix(size)
        d_sym, d_extra, d_bits = _prefix(far + 120)
        symbols[0][back] = 256 + n_sym
    if cache:
        symbols[0][cached] = 280 + place[starts[cached]]
    plain = ~back & ~cached
    if text and len(p) <= SHARED:
        value, n, taken, words = _shared(0)
        w.put(value, n)
    else:
        counts = [np.bincount(symbols[0], minlength=280 + (1 << cache if cache else 0)), *(np.bincount(s[plain], minlength=256) for s in symbols[1:]), np.bincount(d_sym, minlength=40)]
        lengths = [_lengths(c) for c in counts]
        taken, words = [_put_code(w, x) for x in lengths], [_words(x) for x in lengths]
    # in order: green, red, blue, alpha; for a back-reference its length's rest, its distance and that one's rest
    value, bits = words[0][symbols[0]], taken[0][symbols[0]].astype(np.int64)
    value[plain], bits[plain] = _then(value[plain], bits[plain], *((words[c][s], taken[c][s]) for c, s in enumerate(symbols) if c for s in [s[plain]]))
    if found:
        value[back], bits[back] = _then(value[back], bits[back], (n_extra, n_bits), (words[4][d_sym], taken[4][d_sym]), (d_extra, d_bits))
    by, off = divmod(w.n, 8)
    total = off + int(bits.sum())
    packed = _pack(value, bits, off)[: -(-total // 8)]
    if not main:
        w.put(int.from_bytes(packed, "little") >> off, total - off)
        return None
    head = w.value.to_bytes(by + 1, "little")
    return head[:by] + bytes([head[by] | packed[0]]) + packed[1:] if packed else head[:by]


def _then(value: np.ndarray, bits: np.ndarray, *more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of so many bits with others put behind them."""
    for x, n in more:
        value = value | x << bits
        bits = bits + n
    return value, bits


def _pack(value: np.ndarray, bits: np.ndarray, off: int) -> bytes:
    """The values, each of less than 64 bits, one behind another from bit `off` on; zero bytes may follow."""
    at = off + np.cumsum(bits) - bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    value = value.astype(np.uint64)
    # every word has a value that begins there, and its last one alone may reach into the next word
    last = np.concatenate((np.flatnonzero(word[1:] != word[:-1]), [len(word) - 1]))
    out = np.zeros(len(last) + 1, dtype="<u8")
    out[:-1] = np.bitwise_or.reduceat(value << shift, np.concatenate(([0], last[:-1] + 1)))
    out[1:] |= (value[last] >> np.uint64(1)) >> (np.uint64(63) - shift[last])
    return out.tobytes()


def encode_argb(argb: np.ndarray) -> bytes:
    """A WebP file of (height, width) pixels, coded by their content."""
    height, width = argb.shape
    w = Writer().put(0x2F, 8).put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)  # alpha, version
    colors = _distinct(argb) if argb.size > 64 else argb.ravel()
    if argb.size > 64 and len(colors) <= min(256, argb.size // 4):
        n = len(colors)
        shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        w.put(1, 1).put(PALETTE, 2).put(n - 1, 8)
        channels = _channels(colors[None, :])[0]
        differences = np.diff(channels, axis=0, prepend=np.zeros((1, 4), dtype=np.uint8)).astype(np.uint8)
        _put_image(w, differences.view(">u4").astype(np.uint32), False)
        index = np.searchsorted(colors, argb).astype(np.uint32)
        if shift:
            index = np.pad(index, ((0, 0), (0, -width % (1 << shift))))
            each = 8 >> shift
            index = sum(index[:, k :: 1 << shift] << np.uint32(k * each) for k in range(1 << shift))
        argb = np.uint32(0xFF000000) | index << np.uint32(8)
    elif height > 1 and (argb[1:] == argb[:-1]).mean() > 0.5:
        w.put(1, 1).put(PREDICTOR, 2).put(7, 3)  # blocks of 512, all predicted from above
        blocks = (-(-height >> 9), -(-width >> 9))
        _put_image(w, np.full(blocks, 0xFF000000 | 2 << 8, dtype=np.uint32), False)
        c = _channels(argb)
        rest = c.copy()
        rest[1:] -= c[:-1]
        rest[0, 1:] -= c[0, :-1]
        rest[0, 0] -= np.array([255, 0, 0, 0], dtype=np.uint8)
        argb = rest.view(">u4")[..., 0].astype(np.uint32)
    text = w.n == 40  # no transform
    w.put(0, 1)
    return contained(_put_image(w, argb, True, text))


def encode(pixels: np.ndarray) -> bytes:
    """A WebP file of (height, width, 4) red, green, blue, alpha samples."""
    c = pixels.astype(np.uint32)
    return encode_argb(c[..., 3] << np.uint32(24) | c[..., 0] << np.uint32(16) | c[..., 1] << np.uint32(8) | c[..., 2])


def store_payload(payload: bytes) -> bytes:
    """WebP files, one after another, whose samples (green, red, blue, alpha) are the payload, a multiple of 64 bytes."""
    out = []
    for at in range(0, len(payload), 4 * ROW * SIDE):
        x = np.frombuffer(payload, dtype=np.uint8, count=min(4 * ROW * SIDE, len(payload) - at), offset=at).reshape(-1, ROW, 4).astype(np.uint32)
        out.append(encode_argb(x[..., 3] << np.uint32(24) | x[..., 1] << np.uint32(16) | x[..., 0] << np.uint32(8) | x[..., 2]))
    return b"".join(out)


def load_payload(media: bytes) -> tuple[list[np.ndarray], bytes]:
    """The images and the payload they hold."""
    images, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        images.append(decode(media[at : at + size]))
        at += size
    return images, b"".join(i[..., [1, 0, 2, 3]].tobytes() for i in images)


def features(images: list[np.ndarray]) -> str:
    """Of the images' samples: sizes, the mean of each channel, how many values occur, and the commonest one."""
    shape = "+".join(f"{i.shape[1]}x{i.shape[0]}" for i in images)
    n = sum(i.shape[0] * i.shape[1] for i in images)
    sums = sum((i.sum(axis=(0, 1), dtype=np.int64) for i in images), np.zeros(4, dtype=np.int64))
    counts = sum((np.bincount(i.ravel(), minlength=256) for i in images), np.zeros(256, dtype=np.int64))
    means = ",".join(f"{int(s) * 1000 // n}" for s in sums)
    return f"{shape};means/1000={means};values={int((counts > 0).sum())};mode={int(counts.argmax())}"


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_py() or b""
            media = store_payload(data + b"\0" * (-len(data) % 64 if data else 64))
            images, back = load_payload(media)
            rows.append((doc_id.as_py(), len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(images)))
        kinds = [pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64() for n in names]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def round_trip(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes (null: none), zero-padded to a positive multiple of 64, stored as lossless WebP and read back.

    One row for each row of docs, repeated or not; equal texts give equal values. Texts of any length are stored whole,
    in several images from 1 MiB on. Other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_round_trip, _SCHEMA)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], []]
        for media in batch.column(-1):
            try:
                image, error = (decode(media.as_py()), None) if media.is_valid else (None, "null")
            except (ValueError, IndexError, struct.error) as e:
                image, error = None, str(e) or type(e).__name__
            for c, v in zip(out, (None if image is None else image.shape[1], None if image is None else image.shape[0], None if image is None else image.tobytes(), error), strict=True):
                c.append(v)
        yield pa.record_batch([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], names=[*batch.schema.names[:-1], "width", "height", "pixels", "error"])


def decode_column(df: DataFrame, media: str = "media") -> DataFrame:
    """df without its binary column `media`, with width, height, pixels (red, green, blue, alpha, row by row) and error.

    Null and broken media give null pixels and say why in error. Columns named like the results are replaced.
    """
    rest = [c for c in df.columns if c not in (media, "width", "height", "pixels", "error")]
    kept = df.select(*rest)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "width int, height int, pixels binary, error string"])
    return df.select(*rest, media).mapInArrow(_pixels, schema)


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.read(spark, sf_dir, "documents"))

"""A small writer of lossless WebP that uses every feature the decoder reads."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np

from tracewell.llm import webp
from tracewell.llm.webp import LENGTH_ORDER, NEAR, Writer


def huffman(freq: Counter, size: int) -> list[int]:
    out = [0] * size
    if len(freq) == 1:
        out[next(iter(freq))] = 1
        return out
    heap = [(n, s, [s]) for s, n in freq.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    return out


def words(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits as written, count)."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, before = {}, 0, 0
    for n, s in used:
        code <<= n - before
        before = n
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code += 1
    return out


def put_code(w: Writer, freq: Counter, size: int) -> dict[int, tuple[int, int]]:
    freq = freq or Counter({0: 1})
    used = sorted(freq)
    if len(used) <= 2 and used[-1] < 256:
        w.put(1, 1).put(len(used) - 1, 1)
        wide = used[0] > 1
        w.put(int(wide), 1).put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        lengths = [0] * size
        for s in used:
            lengths[s] = 1
        return words(lengths)
    lengths = huffman(freq, size)
    run, i = [], 0
    while i < size:  # with repeats: 16, 17 and 18
        j = i
        while j < size and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if lengths[i] == 0 and n >= 3:
            n = min(n, 138)
            run.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif n >= 4:
            run.append((lengths[i], 0, 0))
            n = min(n - 1, 6)
            run.append((16, n - 3, 2))
            n += 1
        else:
            run.append((lengths[i], 0, 0))
            n = 1
        i += n
    inner = huffman(Counter(s for s, _, _ in run), 19)
    if max(inner) > 7:  # three bits hold a length
        inner = huffman(Counter({s for s, _, _ in run}), 19)
    w.put(0, 1)
    last = max(k for k in range(19) if inner[LENGTH_ORDER[k]])
    last = max(last, 3)
    w.put(last + 1 - 4, 4)
    for k in range(last + 1):
        w.put(inner[LENGTH_ORDER[k]], 3)
    w.put(0, 1)
    code = words(inner)
    for s, x, n in run:
        w.put(*code[s]).put(x, n)
    return words(lengths)


def prefix(v: int) -> tuple[int, int, int]:
    if v <= 4:
        return v - 1, 0, 0
    d = v - 1
    k = d.bit_length() - 1
    return 2 * k + (d >> (k - 1) & 1), d & ((1 << (k - 1)) - 1), k - 1


def put_image(w: Writer, pixels: list[int], width: int, main: bool, cache: int = 0, meta: int = 0) -> None:
    w.put(int(cache > 0), 1)
    if cache:
        w.put(cache, 4)
    height = len(pixels) // width
    group = [0] * len(pixels)
    if main:
        w.put(int(meta > 0), 1)
        if meta:
            w.put(meta - 2, 3)
            bw = -(-width >> meta)
            blocks = [((x + y) % 2) << 8 for y in range(-(-height >> meta)) for x in range(bw)]
            put_image(w, blocks, bw, False)
            group = [blocks[(i // width >> meta) * bw + (i % width >> meta)] >> 8 for i in range(len(pixels))]
    out, held, i = [], [0] * (1 << cache), 0
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache)
    while i < len(pixels):
        best = (0, 0)
        for d in {1, 2, width, width + 1, width - 1, 130} - {0}:
            n = 0
            while d <= i and i + n < len(pixels) and pixels[i + n] == pixels[i + n - d] and n < 300:
                n += 1
            best = max(best, (n, d))
        n, d = best
        if n >= 3:
            near = [k + 1 for k, (x, y) in enumerate(NEAR) if max(1, x + y * width) == d]
            out.append((i, "ref", n, near[0] if near else d + 120))
        elif cache and held[slot(pixels[i])] == pixels[i] and any(held):
            n = 1
            out.append((i, "cache", slot(pixels[i])))
        else:
            n = 1
            out.append((i, "lit", pixels[i]))
        if cache:
            for p in pixels[i : i + n]:
                held[slot(p)] = p
        i += n
    for g in range(max(group) + 1):
        freq = [Counter() for _ in range(5)]
        for i, kind, *x in out:
            if group[i] != g:
                continue
            if kind == "lit":
                p = x[0]
                for f, v in zip(freq, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24), strict=False):
                    f[v] += 1
            elif kind == "ref":
                freq[0][256 + prefix(x[0])[0]] += 1
                freq[4][prefix(x[1])[0]] += 1
            else:
                freq[0][280 + x[0]] += 1
        made = [put_code(w, f, n) for f, n in zip(freq, (280 + (1 << cache if cache else 0), 256, 256, 256, 40), strict=True)]
        codes = [*codes, made] if g else [made]
    for i, kind, *x in out:
        c = codes[group[i]]
        if kind == "lit":
            p = x[0]
            for k, v in zip(c, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24), strict=False):
                w.put(*k[v])
        elif kind == "ref":
            for k, v in ((c[0], x[0]), (c[4], x[1])):
                s, extra, n = prefix(v)
                w.put(*k[s + 256 * (k is c[0])]).put(extra, n)
        else:
            w.put(*c[0][280 + x[0]])


def predict(p: np.ndarray, x: int, y: int, mode: int) -> np.ndarray:
    """The prediction for a pixel (height, width, 4; ints), straight from the format's description."""
    black = np.array([255, 0, 0, 0])
    if x == 0 and y == 0:
        return black
    if y == 0:
        return p[y, x - 1]
    if x == 0:
        return p[y - 1, x]
    left, t, tl = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
    tr = p[y - 1, x + 1] if x + 1 < p.shape[1] else p[y, 0]
    avg = lambda a, b: (a + b) // 2
    if mode == 11:
        guess = left + t - tl
        return left if np.abs(guess - left).sum() < np.abs(guess - t).sum() else t
    if mode == 13:
        a = avg(left, t)
        d = a - tl
        return np.clip(a + np.sign(d) * (np.abs(d) // 2), 0, 255)
    return [black, left, t, tr, tl, avg(avg(left, tr), t), avg(left, tl), avg(left, t), avg(tl, t), avg(t, tr), avg(avg(left, tl), avg(t, tr)), None, np.clip(left + t - tl, 0, 255)][mode]


def pack(p: np.ndarray) -> list[int]:
    """(.., 4) alpha, red, green, blue as numbers."""
    q = p.astype(np.int64)
    return (q[..., 0] << 24 | q[..., 1] << 16 | q[..., 2] << 8 | q[..., 3]).ravel().tolist()


def encode(rgba: np.ndarray, transforms: tuple[str, ...] = (), cache: int = 0, meta: int = 0, seed: int = 0) -> bytes:
    rng = np.random.default_rng(seed)
    height, width, _ = rgba.shape
    p = rgba[..., [3, 0, 1, 2]].astype(np.int64)
    w = Writer().put(0x2F, 8).put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)
    cols = width
    for t in transforms:
        w.put(1, 1)
        shift = 2
        bw, bh = -(-cols >> shift), -(-height >> shift)
        if t == "predictor":
            modes = np.arange(bw * bh) % 14
            w.put(0, 2).put(shift - 2, 3)
            put_image(w, [int(m) << 8 for m in modes], bw, False)
            p = np.array([[(p[y, x] - predict(p, x, y, int(modes[(y >> shift) * bw + (x >> shift)]))) % 256 for x in range(cols)] for y in range(height)])
        elif t == "cross":
            e = rng.integers(0, 256, (bh, bw, 3))
            w.put(1, 2).put(shift - 2, 3)
            put_image(w, pack(np.dstack([np.full((bh, bw), 255), e])), bw, False)
            s = lambda v: (v & 255 ^ 128) - 128
            q = p.copy()
            for y in range(height):
                for x in range(cols):
                    rb, gb, gr = (s(int(v)) for v in e[y >> shift, x >> shift])
                    _, r, g, b = map(int, p[y, x])
                    q[y, x, 1] = (r - (gr * s(g) >> 5)) % 256
                    q[y, x, 3] = (b - (gb * s(g) >> 5) - (rb * s(r) >> 5)) % 256
            p = q
        elif t == "green":
            w.put(2, 2)
            p = p.copy()
            p[..., 1] = (p[..., 1] - p[..., 2]) % 256
            p[..., 3] = (p[..., 3] - p[..., 2]) % 256
        else:
            colors = np.unique(p.reshape(-1, 4), axis=0)
            index = {tuple(c): i for i, c in enumerate(colors.tolist())}
            w.put(3, 2).put(len(colors) - 1, 8)
            put_image(w, pack(np.diff(colors, axis=0, prepend=np.zeros((1, 4), dtype=np.int64)) % 256), len(colors), False)
            n = len(colors)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            per, each = 1 << shift, 8 >> shift
            packed = np.zeros((height, -(-cols // per), 4), dtype=np.int64)
            packed[..., 0] = 255
            for y in range(height):
                for x in range(cols):
                    packed[y, x // per, 2] |= index[tuple(p[y, x].tolist())] << (x % per * each)
            p, cols = packed, packed.shape[1]
    w.put(0, 1)
    put_image(w, pack(p), cols, True, cache, meta)
    return webp.contained(w.value.to_bytes(w.n // 8 + 2, "little"))

"""A plain writer of lossless WebP streams with every feature that a reader must know, for round trips."""

from __future__ import annotations

import heapq
import random
import struct

ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in range(n)]

    def code(self, value, n):
        """A prefix code goes first bit first."""
        self.bits += [(value >> k) & 1 for k in range(n - 1, -1, -1)]

    def done(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


def lengths_of(counts, most=15):
    """Huffman code lengths; counts are flattened until none is over `most`."""
    used = [k for k, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for k in used:
            out[k] = 1
        return out
    flat = 0
    while True:
        heap = [(max(counts[k], flat), n, [k]) for n, k in enumerate(used)]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        n = len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for k in a[2] + b[2]:
                depth[k] += 1
            n += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
        if max(depth.values()) <= most:
            for k, d in depth.items():
                out[k] = d
            return out
        flat = flat * 2 + 1


def canonical(lengths):
    codes, code = {}, 0
    for n in range(1, 16):
        code <<= 1
        for k, m in enumerate(lengths):
            if m == n:
                codes[k] = (code, n)
                code += 1
    return {next(iter(codes)): (0, 0)} if len(codes) == 1 else codes


def write_lengths(w, lengths, rng):
    """Code lengths with runs (16, 17, 18), or the simple form where it fits."""
    used = [k for k, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(k < 256 for k in used) and rng.random() < 0.8:
        w.put(1, 1)
        used = used or [0]
        w.put(len(used) - 1, 1)
        wide = used[0] > 1 or rng.random() < 0.5
        w.put(int(wide), 1)
        w.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    w.put(0, 1)
    last = len(lengths)
    if rng.random() < 0.5:
        while last > 2 and not lengths[last - 1]:
            last -= 1
    symbols, k, before = [], 0, 8
    while k < last:
        run = 1
        while k + run < last and lengths[k + run] == lengths[k]:
            run += 1
        if lengths[k] == 0 and run >= 3:
            n = min(run, 138)
            symbols.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            k += n
        elif lengths[k] == before and lengths[k] and run >= 3:
            n = min(run, 6)
            symbols.append((16, n - 3, 2))
            k += n
        else:
            symbols.append((lengths[k], 0, 0))
            before = lengths[k] or before
            k += 1
    counts = [0] * 19
    for s, _, _ in symbols:
        counts[s] += 1
    own = lengths_of(counts, 7)
    stored = max(4, max(k for k, s in enumerate(ORDER) if own[s]) + 1)
    w.put(stored - 4, 4)
    for s in ORDER[:stored]:
        w.put(own[s], 3)
    if last < len(lengths) or len(symbols) < last:
        w.put(1, 1)
        n = max(2, len(symbols))
        symbols += [(0, 0, 0)] * 0
        size = next(b for b in range(8) if n - 2 < 1 << (2 + 2 * b))
        w.put(size, 3)
        w.put(len(symbols) - 2, 2 + 2 * size)
    else:
        w.put(0, 1)
    codes = canonical(own)
    for s, extra, n in symbols:
        w.code(*codes[s])
        w.put(extra, n)


def split_value(value):
    """Prefix symbol, extra bits and their number of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1


def write_image(w, pixels, width, rng, main=False, cache_bits=0, far=True, groups=False):
    """Entropy-code flat ARGB pixels with literals, cache hits and copies (distances as plain codes over 120)."""
    height = len(pixels) // width
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    group_at = lambda k: 0
    n_groups = 1
    if main:
        w.put(int(groups), 1)
        if groups:
            block = 2
            across, down = -(-width // 4), -(-height // 4)
            names = [rng.randrange(3) for _ in range(across * down)]
            n_groups = max(names) + 1
            w.put(block - 2, 3)
            write_image(w, [0xFF000000 | n << 8 for n in names], across, rng)
            group_at = lambda k: names[(k // width >> block) * across + (k % width >> block)]
    cache = [0] * (1 << cache_bits if cache_bits else 0)
    items, k = [], 0
    key = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while k < len(pixels):
        best = None
        if far and k and rng.random() < 0.7:
            for back in (1, width, rng.randint(1, k)):
                if back <= k:
                    n = 0
                    while k + n < len(pixels) and n < 300 and pixels[k + n] == pixels[k + n - back]:
                        n += 1
                    if n >= 2 and (best is None or n > best[0]):
                        best = (n, back)
        if best:
            n, back = best
            code = 2 if back == 1 else 1 if back == width else back + 120
            items.append((group_at(k), "copy", n, code))
        elif cache_bits and cache[key(pixels[k])] == pixels[k]:
            n = 1
            items.append((group_at(k), "cache", key(pixels[k]), 0))
        else:
            n = 1
            items.append((group_at(k), "pixel", pixels[k], 0))
        if cache_bits:
            for p in pixels[k : k + n]:
                cache[key(p)] = p
        k += n
    sizes = (280 + len(cache), 256, 256, 256, 40)
    counts = [[[0] * s for s in sizes] for _ in range(n_groups)]
    for g, kind, a, b in items:
        c = counts[g]
        if kind == "pixel":
            for j, shift in enumerate((8, 16, 0, 24)):
                c[j][a >> shift & 255] += 1
        elif kind == "cache":
            c[0][280 + a] += 1
        else:
            c[0][256 + split_value(a)[0]] += 1
            c[4][split_value(b)[0]] += 1
    codes = []
    for c in counts:
        own = [lengths_of(x) for x in c]
        for x in own:
            write_lengths(w, x, rng)
        codes.append([canonical(x) if any(x) else {} for x in own])
    for g, kind, a, b in items:
        c = codes[g]
        if kind == "pixel":
            for j, shift in enumerate((8, 16, 0, 24)):
                w.code(*c[j][a >> shift & 255])
        elif kind == "cache":
            w.code(*c[0][280 + a])
        else:
            for table, value, base in ((c[0], a, 256), (c[4], b, 0)):
                symbol, extra, n = split_value(value)
                w.code(*table[base + symbol])
                w.put(extra, n)


def lanes(p):
    return [p >> s & 255 for s in (0, 8, 16, 24)]


def packed(x):
    return x[0] | x[1] << 8 | x[2] << 16 | x[3] << 24


def signed(x):
    return x - 256 if x > 127 else x


def guess(mode, left, top, top_right, top_left):
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [a + b - c for a, b, c in zip(left, top, top_left, strict=True)]
        to_left, to_top = (sum(abs(x - y) for x, y in zip(p, q, strict=True)) for q in (left, top))
        return left if to_left < to_top else top
    return {
        0: [0, 0, 0, 255], 1: left, 2: top, 3: top_right, 4: top_left, 5: mean(mean(left, top_right), top), 6: mean(left, top_left), 7: mean(left, top),
        8: mean(top_left, top), 9: mean(top, top_right), 10: mean(mean(left, top_left), mean(top, top_right)),
        12: [clamp(a + b - c) for a, b, c in zip(left, top, top_left, strict=True)],
        13: [clamp(m + (abs(m - c) // 2) * (1 if m >= c else -1)) for m, c in zip(mean(left, top), top_left, strict=True)],
    }[mode]


def encode(pixels, width, steps=(), seed=0, **image):
    """A file of flat ARGB pixels. steps: transforms in the order they are applied."""
    rng = random.Random(seed)
    height = len(pixels) // width
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    now = width
    for step in steps:
        w.put(1, 1)
        if step == "green":
            w.put(2, 2)
            pixels = [packed([(b - g) & 255, g, (r - g) & 255, a]) for b, g, r, a in map(lanes, pixels)]
        elif step == "palette":
            w.put(3, 2)
            table = sorted(set(pixels))
            w.put(len(table) - 1, 8)
            deltas = [packed([(x - y) & 255 for x, y in zip(lanes(p), lanes(q), strict=True)]) for p, q in zip(table, [0, *table], strict=False)]
            write_image(w, deltas, len(table), rng)
            bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            wide, out = 8 >> bits, []
            for y in range(height):
                row = [table.index(p) for p in pixels[y * now : (y + 1) * now]]
                for x in range(0, now, 1 << bits):
                    out.append(0xFF000000 | sum(v << (wide * k) for k, v in enumerate(row[x : x + (1 << bits)])) << 8)
            pixels, now = out, -(-now // (1 << bits))
        else:
            w.put(0 if step == "predictor" else 1, 2)
            w.put(0, 3)
            across, down = -(-now // 4), -(-height // 4)
            at = lambda x, y, across=across: (y >> 2) * across + (x >> 2)
            if step == "predictor":
                modes = [rng.randrange(14) for _ in range(across * down)]
                write_image(w, [0xFF000000 | m << 8 for m in modes], across, rng)
                rows = [lanes(p) for p in pixels]
                out = []
                for k, own in enumerate(rows):
                    y, x = divmod(k, now)
                    if y == 0:
                        g = rows[k - 1] if x else [0, 0, 0, 255]
                    elif x == 0:
                        g = rows[k - now]
                    else:
                        g = guess(modes[at(x, y)], rows[k - 1], rows[k - now], rows[k - now + 1], rows[k - now - 1])
                    out.append(packed([(a - b) & 255 for a, b in zip(own, g, strict=True)]))
                pixels = out
            else:
                factors = [[rng.randrange(256) for _ in range(3)] for _ in range(across * down)]
                write_image(w, [0xFF000000 | rb << 16 | gb << 8 | gr for gr, gb, rb in factors], across, rng)
                out = []
                for k, p in enumerate(pixels):
                    y, x = divmod(k, now)
                    gr, gb, rb = map(signed, factors[at(x, y)])
                    b, g, r, a = lanes(p)
                    out.append(packed([(b - (gb * signed(g) >> 5) - (rb * signed(r) >> 5)) & 255, g, (r - (gr * signed(g) >> 5)) & 255, a]))
                pixels = out
    w.put(0, 1)
    write_image(w, pixels, now, rng, main=True, **image)
    body = w.done()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk

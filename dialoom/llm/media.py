"""Media columns: lossless WebP (VP8L) bytes to pixel arrays, and the other way round.

decode() reads any lossless WebP still: simple and normal prefix codes, groups of codes chosen by an entropy image,
back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms.
encode_samples() writes streams with prefix codes, back-references, a colour cache and the transforms, each where it makes
the stream shorter; `method` names what a stream uses.

Column operators:
  text_to_media(df)   text -> media (binary), n_bytes, payload_bytes
  decode_media(df)    media -> width, height, pixels (binary, ARGB as little-endian 32-bit), digests, feature and method

Defined results: a null or empty text is a payload of 64 zero bytes; texts of any length are stored whole; repeated rows
give repeated rows; an empty table gives an empty one; of further columns only the asked-for id is kept. Null or broken
media decode to null columns, with the reason in `error`.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, on_texts, sliced

# Fixed values of the format: the order in which code length code lengths are stored.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]

# Fixed values of the format: (x, y) offsets of the first 120 distance codes.
DISTANCE_OFFSETS = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]

# Fixed values of the format: (value, extra bits, least number) of the runs of code lengths 0.
RUNS = {17: (0, 3, 3), 18: (0, 7, 11)}

CHUNK = 1 << 20
STREAM = 1 << 15  # bytes of a stream whose bits are looked at together
COPY = 1 << 30  # stands for the end of a token whose size isn't known yet
WORD = struct.Struct("<Q").unpack_from
LONGEST = 10  # bits of a code that is written: more would hardly shorten streams, but double the reader's tables
HASH = 0x1E35A7BD  # a fixed value of the format, by which the colour cache finds a pixel's place


class MediaError(ValueError):
    """The bytes are not a whole lossless WebP still."""


class Bits:
    """Bits of a byte string, the lowest of each byte first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.end = 8 * len(data)
        self.data, self.at = data + bytes(16), at

    def span(self, first: int, n: int) -> int:
        return (int.from_bytes(self.data[first >> 3 : (first + n + 7) >> 3], "little") >> (first & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise MediaError("the stream ends early")
        value = self.span(self.at, n)
        self.at += n
        return value


@functools.cache
def _turned(width: int) -> np.ndarray:
    """All numbers of `width` bits, with their bits in the opposite order."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class PrefixCode:
    """A canonical prefix code, from the code length of each symbol. A lone symbol takes no bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if not len(used):
            used, self.width = np.zeros(1, int), 0
        elif len(used) == 1:
            self.width = 0
        else:
            self.width = int(lengths[used].max())
            if int((1 << (self.width - lengths[used])).sum()) != 1 << self.width:
                raise MediaError("a prefix code is over- or undersubscribed")
        self.ordered = used[np.argsort(lengths[used], kind="stable")]
        self.sizes = lengths[self.ordered] if self.width else np.zeros(1, np.int64)
        self.flat = bool((self.sizes == self.width).all())
        self.most = int(used.max())
        self.mask = (1 << self.width) - 1
        self.tables: dict[int, list[int]] = {}

    @functools.cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """By the next `width` bits: symbols, and numbers of bits."""
        order = _turned(self.width)
        times = 1 << (self.width - self.sizes)
        return np.repeat(self.ordered, times)[order].astype(np.int32), np.repeat(self.sizes, times)[order].astype(np.uint8)

    def table(self, shift: int = 0) -> list[int]:
        """By the next `width` bits, the first bit lowest: (symbol << shift) << 6 | bits; symbols of 256 and more, which
        only the first code of a group has, as their complement with a shift of 0."""
        if shift not in self.tables:
            value = (self.ordered << (shift + 6)) | self.sizes
            if shift:
                value = np.where(self.ordered < 256, value, ~(self.ordered << 6 | self.sizes))
            self.tables[shift] = np.repeat(value, 1 << (self.width - self.sizes))[_turned(self.width)].tolist()
        return self.tables[shift]


@functools.lru_cache(64)
def _known_code(lengths: bytes) -> PrefixCode:
    return PrefixCode(np.frombuffer(lengths, np.int64))


def prefix_code(lengths: np.ndarray) -> PrefixCode:
    """Channels, and images of one source, often share their codes."""
    return _known_code(lengths.tobytes())


def _small_table(lengths: list[int]) -> tuple[list[int], int]:
    """The table of the code of code lengths (seven bits at most), entries as in PrefixCode.table, and its mask."""
    used = [k for k in range(19) if lengths[k]]
    if len(used) < 2:
        return [(used[0] if used else 0) << 6], 0
    width = max(lengths)
    table: list[int] = [0] * (1 << width)
    place = 0
    turned = _turned(width)
    for n in range(1, width + 1):
        for k in used:
            if lengths[k] == n:
                if place >= 1 << width:
                    raise MediaError("a prefix code is over- or undersubscribed")
                first = int(turned[place])
                table[first :: 1 << n] = [k << 6 | n] * (1 << (width - n))
                place += 1 << (width - n)
    if place != 1 << width:
        raise MediaError("a prefix code is over- or undersubscribed")
    return table, (1 << width) - 1


def read_prefix_code(bits: Bits, alphabet: int) -> PrefixCode:
    data, at, end = bits.data, bits.at, bits.end
    if at >= end:
        raise MediaError("the stream ends early")
    ahead = int.from_bytes(data[at >> 3 : (at >> 3) + 16], "little") >> (at & 7)  # a header has 82 bits at most
    if ahead & 1:
        lengths = np.zeros(alphabet, np.int64)
        bits.at += 1
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= alphabet:
            raise MediaError("a symbol lies outside its alphabet")
        lengths[symbols] = 1
        return prefix_code(lengths)
    stored = 4 + (ahead >> 1 & 15)
    ahead >>= 5
    own = [0] * 19
    for k in CODE_LENGTH_ORDER[:stored]:
        own[k] = ahead & 7
        ahead >>= 3
    table, mask = _small_table(own)
    left = alphabet
    at += 5 + 3 * stored + 1
    if ahead & 1:
        n = 2 + 2 * (ahead >> 1 & 7)
        left = 2 + (ahead >> 4 & ((1 << n) - 1))
        at += 3 + n
        if left > alphabet:
            raise MediaError("more code lengths than symbols")
    found: list[int] = []
    before = 8
    while len(found) < alphabet and left:
        left -= 1
        if at >= end and mask:
            raise MediaError("the stream ends early")
        ahead = WORD(data, at >> 3)[0] >> (at & 7)
        entry = table[ahead & mask]
        symbol, n = entry >> 6, entry & 63
        at += n
        if symbol < 16:
            found.append(symbol)
            before = symbol or before
            continue
        value, extra, least = RUNS[symbol] if symbol > 16 else (before, 2, 3)
        found += [value] * (least + (ahead >> n & ((1 << extra) - 1)))
        at += extra
    if at > end:
        raise MediaError("the stream ends early")
    if len(found) > alphabet:
        raise MediaError("code lengths run over their alphabet")
    bits.at = at
    return prefix_code(np.array(found + [0] * (alphabet - len(found)), np.int64))


def read_group(bits: Bits, cache_size: int) -> list[PrefixCode]:
    """The five codes of a group. A code that is stored as the one before, bit by bit, is not read again."""
    codes: list[PrefixCode] = []
    first = before = 0
    for n in (256 + 24 + cache_size, 256, 256, 256, 40):
        size = bits.at - first
        if len(codes) in (1, 2, 3) and codes[-1].most < 256 and bits.at + size <= bits.end and bits.span(bits.at, size) == before:
            first = bits.at
            bits.at += size
            codes.append(codes[-1])
            continue
        first = bits.at
        codes.append(read_prefix_code(bits, n))
        before = bits.span(first, bits.at - first)
    return codes


def _extended(bits: Bits, symbol: int) -> int:
    """The value of a length or distance symbol with its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _flat_pixels(bits: Bits, codes: list[PrefixCode], count: int) -> np.ndarray:
    """All pixels of a stream in which each takes the same number of bits."""
    widths = [c.width for c in codes[:4]]
    each = sum(widths)
    if bits.at + each * count > bits.end:
        raise MediaError("the stream ends early")
    out = np.empty(count, np.uint32)
    shifts = (8, 16, 0, 24)
    step = max(1, CHUNK // max(each, 1))
    for first in range(0, count, step):
        n = min(step, count - first)
        start = bits.at + first * each
        piece = np.frombuffer(bits.data, np.uint8, (start + n * each + 7) // 8 - start // 8, start // 8)
        grid = np.unpackbits(piece, bitorder="little")[start % 8 : start % 8 + n * each].reshape(n, each)
        value, left = np.zeros(n, np.uint32), 0
        for code, width, shift in zip(codes, widths, shifts, strict=False):
            if width == 0:
                value |= np.uint32(int(code.ordered[0]) << shift)
                continue
            if width <= 8:
                wide = np.zeros((n, 8), np.uint8)
                wide[:, 8 - width :] = grid[:, left : left + width]
                rank = np.packbits(wide, axis=1)[:, 0].astype(np.int64)
            else:
                rank = grid[:, left : left + width].astype(np.int64) @ (1 << np.arange(width - 1, -1, -1))
            value |= code.ordered[rank].astype(np.uint32) << np.uint32(shift)
            left += width
        out[first : first + n] = value
    bits.at += each * count
    return out


def _read_copy(bits: Bits, symbol: int, far_code: PrefixCode, width: int) -> tuple[int, int]:
    """Length and distance of a back-reference; the bits stand behind its green symbol."""
    length = _extended(bits, symbol - 256)
    entry = far_code.table()[WORD(bits.data, bits.at >> 3)[0] >> (bits.at & 7) & far_code.mask]
    bits.at += entry & 63
    far = _extended(bits, entry >> 6)
    if far > 120:
        return length, far - 120
    x, y = DISTANCE_OFFSETS[far - 1]
    return length, max(1, x + y * width)


def _read_tokens(bits: Bits, codes: list[PrefixCode], width: int, count: int, cache_bits: int, met: set[str]) -> np.ndarray:
    """All pixels of a stream with one group of codes.

    The size of the token that would start at each bit is found for all bits of a part of the stream at once; then only the
    chain of starts is followed one by one, and symbols are read at all of them together. Copies and cache hits are filled in
    in their order.
    """
    green, red, blue, alpha, far_code = codes
    symbols, sizes = green.arrays
    kinds = None if green.most < 256 else np.where(symbols < 256, 0, np.where(symbols < 280, 2, 1)).astype(np.uint8)
    others = [c.arrays for c in (red, blue, alpha)]
    masks = [np.uint16(c.mask) for c in codes]
    out = np.empty(count, np.uint32)
    cache = [0] * (1 << cache_bits)
    turn = 32 - cache_bits
    data, last, made = bits.data, (bits.end + 7) >> 3, 0
    while made < count:
        origin = bits.at >> 3
        n = min(STREAM, last - origin)
        if bits.at >= bits.end and (green.width or red.width or blue.width or alpha.width):
            raise MediaError("the stream ends early")
        n = max(n, 1)
        raw = np.frombuffer(data, np.uint8, min(n + 11, len(data) - origin), origin).astype(np.uint32)
        raw = np.concatenate([raw, np.zeros(n + 11 - len(raw), np.uint32)])
        words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16)
        ahead = (words[:, None] >> np.arange(8, dtype=np.uint32)).astype(np.uint16).ravel()
        limit = 8 * n
        first = ahead[:limit] & masks[0]
        after = np.arange(limit, dtype=np.int32) + sizes[first]
        hop, before = after, None
        for k, (_, own) in enumerate(others):
            if codes[k + 1].width:
                if codes[k + 1] is not before:
                    before, here = codes[k + 1], own[ahead & masks[k + 1]]
                hop = hop + here[hop]
        if kinds is not None:
            kind = kinds[first]
            hop = np.where(kind == 0, hop, np.where(kind == 1, after, COPY))
        jump = memoryview(np.ascontiguousarray(hop, np.int32))
        at, starts, copies = bits.at - 8 * origin, [], []
        put, left = starts.append, count - made
        while left > 0 and at < limit:
            had = len(starts)
            for _ in range(left):
                if at >= limit:
                    break
                put(at)
                at = jump[at]
            left -= len(starts) - had
            if at == COPY:
                left += 1
                start = starts.pop()
                bits.at = 8 * origin + int(after[start])
                length, far = _read_copy(bits, int(symbols[first[start]]), far_code, width)
                if far > count - left or length > left:
                    raise MediaError("a back-reference leaves the image")
                copies.append((len(starts), length, far))
                left -= length
                at = bits.at - 8 * origin
        bits.at = 8 * origin + at
        if bits.at > bits.end:
            raise MediaError("the stream ends early")
        places = np.array(starts, np.int64)
        own = symbols[first[places]]
        hit = own >= 280
        pixels = own.astype(np.uint32) << np.uint32(8)
        places = after[places]
        for k, ((names, bits_of), shift) in enumerate(zip(others, (16, 0, 24), strict=True)):
            entry = ahead[places] & masks[k + 1]
            pixels |= names[entry].astype(np.uint32) << np.uint32(shift)
            places = places + bits_of[entry]
        if cache_bits:
            if hit.any():
                met.add("cache")
            slots = np.where(hit, own - 280, (pixels * np.uint32(HASH)) >> np.uint32(turn)).tolist()
            done: list[int] = out[:made].tolist() if copies else []
            skipped = 0 if copies else made
            values, hits = pixels.tolist(), hit.tolist()
            for (a, length, far), b in zip([(0, 0, 1), *copies], [*(c[0] for c in copies), len(values)], strict=True):
                if length:
                    piece = done[len(done) - far : len(done) - far + length]
                    piece = (piece * (length // far + 1))[:length] if far < length else piece
                    done += piece
                    for pixel in piece:
                        cache[((HASH * pixel) & 0xFFFFFFFF) >> turn] = pixel
                for k in range(a, b):
                    if hits[k]:
                        done.append(cache[slots[k]])
                    else:
                        cache[slots[k]] = values[k]
                        done.append(values[k])
            out[made : skipped + len(done)] = done[made - skipped :]
            made = skipped + len(done)
        else:
            edges = [0, *(c[0] for c in copies), len(pixels)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if k:
                    _, length, far = copies[k - 1]
                    piece = out[made - far : min(made, made - far + length)]
                    out[made : made + length] = piece if far >= length else np.resize(piece, length)
                    made += length
                out[made : made + b - a] = pixels[a:b]
                made += b - a
        if copies:
            met.add("back-references")
    return out


def read_image(bits: Bits, width: int, height: int, main: bool = False, met: set[str] | None = None) -> np.ndarray:
    """An entropy-coded image as flat ARGB. met gets the names of the parts of the format that it uses."""
    met = set() if met is None else met
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise MediaError("the colour cache is too large")
    groups_of, block, across = None, 0, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width // (1 << block))
        groups_of = ((read_image(bits, across, -(-height // (1 << block))) >> np.uint32(8)) & np.uint32(0xFFFF)).tolist()
        met.add("entropy image")
    groups = [read_group(bits, 1 << cache_bits if cache_bits else 0) for _ in range(1 if groups_of is None else max(groups_of) + 1)]
    count = width * height
    if len(groups) == 1 and all(c.flat for c in groups[0][:4]) and groups[0][0].most < 256:
        met.add("flat codes")
        return _flat_pixels(bits, groups[0], count)
    met.add("prefix codes")
    if len(groups) == 1:
        return _read_tokens(bits, groups[0], width, count, cache_bits, met)
    tables = [[(c.table(shift), c.mask) for c, shift in zip(g[:4], (8, 16, 0, 24), strict=True)] for g in groups]
    deep = max(sum(c.width for c in g[:4]) for g in groups) > 57
    (greens, green_mask), (reds, red_mask), (blues, blue_mask), (alphas, alpha_mask) = tables[0]
    out: list[int] = []
    put = out.append
    cache = [0] * (1 << cache_bits)
    turn = 32 - cache_bits
    data, pos, end, at, block_at = bits.data, bits.at, bits.end, 0, -1
    while at < count:
        if groups_of is not None and (now := (at // width >> block) * across + (at % width >> block)) != block_at:
            block_at = now
            (greens, green_mask), (reds, red_mask), (blues, blue_mask), (alphas, alpha_mask) = tables[groups_of[now]]
        if pos > end:
            raise MediaError("the stream ends early")
        ahead = int.from_bytes(data[pos >> 3 : (pos >> 3) + 16], "little") >> (pos & 7) if deep else WORD(data, pos >> 3)[0] >> (pos & 7)
        entry = greens[ahead & green_mask]
        if entry >= 0:  # a literal: the entries of its channels add up to the pixel and its number of bits
            ahead >>= entry & 63
            own = reds[ahead & red_mask]
            entry += own
            ahead >>= own & 63
            own = blues[ahead & blue_mask]
            entry += own + alphas[ahead >> (own & 63) & alpha_mask]
            pos += entry & 63
            entry >>= 6
            put(entry)
            at += 1
            if cache_bits:
                cache[((HASH * entry) & 0xFFFFFFFF) >> turn] = entry
            continue
        entry = ~entry
        symbol = entry >> 6
        pos += entry & 63
        if symbol >= 280:
            put(cache[symbol - 280])
            at += 1
            met.add("cache")
            continue
        bits.at = pos
        length, far = _read_copy(bits, symbol, groups[0 if groups_of is None else groups_of[block_at]][4], width)
        pos = bits.at
        if far > at or at + length > count:
            raise MediaError("a back-reference leaves the image")
        piece = out[at - far : at - far + length]
        if far < length:
            piece = (piece * (length // far + 1))[:length]
        out += piece
        at += length
        met.add("back-references")
        if cache_bits:
            for pixel in piece:
                cache[((HASH * pixel) & 0xFFFFFFFF) >> turn] = pixel
    if pos > end:
        raise MediaError("the stream ends early")
    bits.at = pos
    return np.array(out, np.uint32)


def _lanes(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def predicted(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    """What a predictor mode expects of a pixel, lane by lane."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        by_top = sum(abs(a - c) for a, c in zip(left, top_left, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [min(255, max(0, a + t - c)) for a, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(_average(left, top), top_left, strict=True)]
    return [0, 0, 0, 255]


def invert_predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, block: int) -> np.ndarray:
    across = -(-width // (1 << block))
    rest = _lanes(pixels.reshape(height, width))
    if height == 1 or (modes == 0).all() or (modes == 1).all():
        out = rest.copy()
        if height == 1 or (modes == 1).all():  # sums along the rows, and down the first column
            out[0, :1, 3] += np.uint8(255)
            out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
            if height > 1:
                out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
                out[1:] = np.cumsum(out[1:], axis=1, dtype=np.uint8)
        else:
            out[1:, 1:, 3] += 255
            out[0, :1, 3] += np.uint8(255)
            out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
            out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
        return out.reshape(-1, 4).copy().view("<u4")[:, 0].astype(np.uint32)
    rows = rest.tolist()
    for y in range(height):
        row, above = rows[y], rows[y - 1] if y else None
        for x in range(width):
            if above is None:
                guess = row[x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = above[0]
            else:
                mode = int(modes[(y >> block) * across + (x >> block)])
                corner = above[x + 1] if x + 1 < width else row[0]
                guess = predicted(mode, row[x - 1], above[x], corner, above[x - 1])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], guess, strict=True)]
    return np.array(rows, np.uint8).reshape(-1, 4).copy().view("<u4")[:, 0].astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int8).astype(np.int64)


def invert_cross_colour(pixels: np.ndarray, width: int, height: int, factors: np.ndarray, block: int) -> np.ndarray:
    across = -(-width // (1 << block))
    ys, xs = np.divmod(np.arange(width * height), width)
    factor = factors[(ys >> block) * across + (xs >> block)]
    green = _signed((pixels >> np.uint32(8)).astype(np.uint8))
    red = ((pixels >> np.uint32(16)) & np.uint32(255)).astype(np.int64)
    blue = (pixels & np.uint32(255)).astype(np.int64)
    green_to_red, green_to_blue, red_to_blue = (_signed((factor >> np.uint32(k)).astype(np.uint8)) for k in (0, 8, 16))
    red = (red + ((green_to_red * green) >> 5)) & 255
    blue = blue + ((green_to_blue * green) >> 5) + ((red_to_blue * _signed(red.astype(np.uint8))) >> 5)
    return (pixels & np.uint32(0xFF00FF00)) | (red << 16).astype(np.uint32) | (blue & 255).astype(np.uint32)


def add_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    red_blue = ((pixels & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)) & np.uint32(0x00FF00FF)
    return (pixels & np.uint32(0xFF00FF00)) | red_blue


def invert_palette(pixels: np.ndarray, packed: int, width: int, height: int, palette: np.ndarray, pack: int) -> np.ndarray:
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(height, packed)
    if pack:
        wide = 8 >> pack
        shifts = np.arange(1 << pack, dtype=np.uint32) * np.uint32(wide)
        index = ((index[:, :, None] >> shifts) & np.uint32((1 << wide) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index.ravel()]


def decode_vp8l(data: bytes, met: set[str] | None = None) -> tuple[int, int, np.ndarray]:
    """Width, height and flat ARGB pixels of a VP8L chunk. met gets the names of the parts of the format that it uses."""
    met = set() if met is None else met
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise MediaError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise MediaError("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise MediaError("a transform occurs twice")
        seen.add(kind)
        met.add(("predictor", "cross-colour", "green", "palette")[kind])
        if kind < 2:
            block = bits.read(3) + 2
            side = read_image(bits, -(-now // (1 << block)), -(-height // (1 << block)))
            if kind == 0:
                modes = ((side >> np.uint32(8)) & np.uint32(15)).astype(np.int64)
                undo.append(lambda p, w=now, m=modes, b=block: invert_predictor(p, w, height, m, b))
            else:
                undo.append(lambda p, w=now, s=side, b=block: invert_cross_colour(p, w, height, s, b))
        elif kind == 2:
            undo.append(add_green)
        else:
            size = bits.read(8) + 1
            deltas = _lanes(read_image(bits, size, 1))
            palette = np.cumsum(deltas, axis=0, dtype=np.uint8).view("<u4")[:, 0].astype(np.uint32)
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            packed = -(-now // (1 << pack))
            undo.append(lambda p, w=now, k=packed, t=palette, b=pack: invert_palette(p, k, w, height, t, b))
            now = packed
    pixels = read_image(bits, now, height, True, met)
    for step in reversed(undo):
        pixels = step(pixels)
    return width, height, pixels


def decode(data: bytes, met: set[str] | None = None) -> tuple[int, int, np.ndarray]:
    """Width, height and flat ARGB pixels of a WebP file with a lossless still."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise MediaError("no WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise MediaError("the stream ends early")
            return decode_vp8l(data[at + 8 : at + 8 + size], met)
        at += 8 + size + (size & 1)
    raise MediaError("no lossless chunk")


def dimensions(samples: int) -> tuple[int, int]:
    """A width and height for a multiple of 64 samples, four to the pixel."""
    rows = samples // 64
    times = -(-rows // 16384)
    if times > 1024:
        raise MediaError("more samples than one image can hold")
    return 16 * times, -(-rows // times)


class BitWriter:
    """Numbers and their sizes in bits, packed at the end in numpy."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: list[int] = []
        self.few_sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.few.append(value)
        self.few_sizes.append(size)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._settle()
        self.values.append(values)
        self.sizes.append(sizes)

    def _settle(self) -> None:
        if self.few:
            self.values.append(np.array(self.few, np.uint64))
            self.sizes.append(np.array(self.few_sizes, np.int64))
            self.few, self.few_sizes = [], []

    def done(self) -> bytes:
        """Each number, of 63 bits at most, reaches into two words at most; those that start in one word are joined by or."""
        self._settle()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, off = starts >> 6, (starts & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(values << off, first)
        over = np.flatnonzero((starts & 63) + sizes > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - off[over])
        return out.astype("<u8").tobytes()[: (int(ends[-1]) + 7) >> 3]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of the symbols that occur; small counts are raised until no code is longer than `most`."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    own, least = counts[used], 0
    while True:
        n = len(used)
        weights = np.maximum(own, least)
        order = np.argsort(weights, kind="stable")
        total = weights[order].tolist()  # leaves from light to heavy, then the nodes, whose weights grow too
        above = [0] * (2 * n - 1)
        leaf, node = 0, n
        for now in range(n, 2 * n - 1):
            weight = 0
            for _ in (0, 1):
                if leaf < n and (node >= now or total[leaf] <= total[node]):
                    weight += total[leaf]
                    above[leaf] = now
                    leaf += 1
                else:
                    weight += total[node]
                    above[node] = now
                    node += 1
            total.append(weight)
        deep = [0] * (2 * n - 1)
        for now in range(2 * n - 3, -1, -1):
            deep[now] = deep[above[now]] + 1
        if max(deep[:n]) <= most:
            out[used[order]] = deep[:n]
            return out
        least = 2 * least + max(1, int(own.sum()) >> (most + 2))


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of each symbol's code, first bit lowest, and their number; a lone symbol takes none."""
    used = np.flatnonzero(lengths)
    codes, sizes = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    if len(used) > 1:
        own = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[own]
        width = int(size[-1])
        place = np.cumsum(1 << (width - size)) - (1 << (width - size))
        codes[own], sizes[own] = _turned(width)[place], size
    return codes, sizes


def put_code(w: BitWriter, lengths: np.ndarray) -> None:
    """Store code lengths: one or two symbols below 256 as they are, others with runs under a code of their own."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        w.put(int(wide), 1)
        w.put(symbols[0], 8 if wide else 1)
        if len(symbols) > 1:
            w.put(symbols[1], 8)
        return
    last = int(used[-1]) + 1
    own = lengths[:last]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    tokens: list[int] = []  # symbols, with the value of their extra bits above
    for value, times in zip(own[first].tolist(), np.diff(np.append(first, last)).tolist(), strict=True):
        if value:
            tokens.append(value)
            times -= 1
        while times >= 3:
            n = min(times, 6 if value else 138)
            tokens.append(16 | n - 3 << 5 if value else 17 | n - 3 << 5 if n <= 10 else 18 | n - 11 << 5)
            times -= n
        tokens += [value] * times
    counts = [0] * 19
    for t in tokens:
        counts[t & 31] += 1
    lens = code_lengths(np.array(counts), 7)
    listed = lens.tolist()
    stored = max(4, max(k for k, s in enumerate(CODE_LENGTH_ORDER) if listed[s]) + 1)
    w.put((stored - 4) << 1, 5)
    w.put(sum(listed[s] << 3 * k for k, s in enumerate(CODE_LENGTH_ORDER[:stored])), 3 * stored)
    if len(tokens) >= 2:
        size = next(k for k in range(8) if len(tokens) - 2 < 1 << (2 + 2 * k))
        w.put(1 | size << 1, 4)
        w.put(len(tokens) - 2, 2 + 2 * size)
    else:
        w.put(0, 1)
    codes, sizes = (x.tolist() for x in codes_of(lens))
    extra = [0] * 16 + [2, 3, 7]
    w.few += [codes[t & 31] | t >> 5 << sizes[t & 31] for t in tokens]
    w.few_sizes += [sizes[t & 31] + extra[t & 31] for t in tokens]


def with_extra(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol, the extra bits and their number of lengths or distances."""
    less = values - 1
    high = np.frexp(np.maximum(less, 1).astype(float))[1] - 1
    extra = np.maximum(high - 1, 0)
    symbol = np.where(less < 4, less, 2 * high + (less >> np.maximum(high - 1, 0) & 1))
    extra = np.where(less < 4, 0, extra)
    return symbol, less & ((1 << extra) - 1), extra


def find_copies(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of copies: runs of places whose next three pixels stood the same distance before.

    All earlier places with the same three pixels are found by one sort; the nearest counts. Copies don't overlap.
    """
    none = np.zeros(0, np.int64)
    if len(pixels) < 8:
        return none, none, none
    key = pixels[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (pixels[1:-1].astype(np.uint64) << np.uint64(21)) * np.uint64(0xC4CEB9FE1A85EC53) ^ pixels[2:].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return none, none, none
    far = np.zeros(len(key), np.int64)
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    at = np.flatnonzero(far)
    back = at - far[at]
    at = at[(pixels[at] == pixels[back]) & (pixels[at + 1] == pixels[back + 1]) & (pixels[at + 2] == pixels[back + 2])]
    if not len(at):
        return none, none, none
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(far[at]) != 0)]))
    runs = np.diff(np.append(first, len(at))) + 2
    out, upto = [], 0
    for start, length, distance in zip(at[first].tolist(), runs.tolist(), far[at[first]].tolist(), strict=True):
        end = start + length
        start = max(start, upto)
        if end - start < 3:
            continue
        for k in range(start, end, 4096):
            out.append((k, min(4096, end - k), distance))
        upto = end
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


_SHARES = np.arange(1 << 12) * np.log2(np.maximum(np.arange(1 << 12), 1))


def _bits(counts: np.ndarray, wholes: np.ndarray) -> float:
    """What symbols with these counts take under ideal codes; wholes: the sums of the counts of each code."""
    counts = np.concatenate([counts.ravel(), wholes])
    if counts.max(initial=0) < len(_SHARES):
        each = _SHARES[counts]
    else:
        each = counts * np.log2(np.maximum(counts, 1))
    return 2 * float(each[len(counts) - len(wholes) :].sum()) - float(each.sum())


def put_image(w: BitWriter, pixels: np.ndarray, main: bool = False) -> None:
    """Entropy-code flat ARGB: copies, hits of a colour cache if they shorten the stream, and literals."""
    starts, lengths, distances = find_copies(pixels)
    if 14 * int(lengths.sum()) < 32 * len(starts) + 400:  # codes of their own for green and distances cost more
        starts = lengths = distances = starts[:0]
    at = np.arange(len(pixels))
    if len(starts):
        at = np.delete(at, np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum())))
    lanes = _lanes(pixels[at])  # blue, green, red, alpha
    places = np.arange(4) * 256
    histograms = np.bincount((lanes + places).ravel(), minlength=1024).reshape(4, 256)
    hits = slots = None
    cache_bits = max(0, min(10, len(pixels).bit_length() - 5))
    if cache_bits and len(at) > 256:
        slot = ((pixels * np.uint32(HASH)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        known = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
        hit = np.zeros(len(pixels), bool)
        hit[order[1:][known]] = True
        hit = hit[at]
        others = np.bincount((lanes[~hit] + places).ravel(), minlength=1024).reshape(4, 256)
        used = np.bincount(slot[at[hit]], minlength=1 << cache_bits)
        wholes = np.full(4, len(at) - int(hit.sum()))
        before = _bits(histograms, np.full(4, len(at)))
        after = _bits(np.concatenate([others.ravel(), used]), wholes + np.array([0, int(hit.sum()), 0, 0])) + 5 * np.count_nonzero(used)
        if after < 0.95 * before:
            hits, slots, histograms = hit, slot, others
    cache_size = 1 << cache_bits if hits is not None else 0
    w.put(1 | cache_bits << 1, 5) if cache_size else w.put(0, 1)
    if main:
        w.put(0, 1)
    green = histograms[1]
    if len(starts) or cache_size:
        length_symbol, length_extra, length_size = with_extra(lengths)
        far_symbol, far_extra, far_size = with_extra(distances + 120)
        green = np.concatenate([green, np.bincount(length_symbol, minlength=24), *([np.bincount(slots[at[hits]], minlength=cache_size)] if cache_size else [])])
    # channels share one code, green only without copies and cache, and none that never changes
    alone = (np.count_nonzero(histograms, axis=1) <= 1)[[2, 0, 3]].tolist()
    together = len(green) == 256 and not any(alone)
    shared = histograms[[0, 2, 3]].sum(axis=0) + (green if together else 0)
    common = code_lengths(shared, LONGEST) if not all(alone) else None
    far_lens = code_lengths(np.bincount(far_symbol, minlength=40), LONGEST) if len(starts) else np.zeros(40, np.int64)
    lens = [common if together else code_lengths(green, LONGEST), *(code_lengths(histograms[k], LONGEST) if x else common for k, x in zip((2, 0, 3), alone, strict=True)), far_lens]
    for k, x in enumerate(lens):
        if k in (1, 2, 3) and x is lens[k - 1] is common:  # the same bits again
            w.few += w.few[first:]
            w.few_sizes += w.few_sizes[first:]
            first += (len(w.few) - first) // 2
            continue
        first = len(w.few)
        put_code(w, x)
    of = [codes_of(common)] * 3 if not any(alone) else [codes_of(x) for x in lens[1:4]]
    green_codes, green_sizes = of[0] if together else codes_of(lens[0])
    symbols = lanes[:, 1].astype(np.int64)
    values, sizes = green_codes[symbols], green_sizes[symbols]
    for (codes, own), lane in zip(of, (2, 0, 3), strict=True):
        symbol = lanes[:, lane]
        values = values | codes[symbol] << sizes.astype(np.uint64)
        sizes = sizes + own[symbol]
    if hits is not None:
        symbols = 280 + slots[at[hits]].astype(np.int64)
        values[hits], sizes[hits] = green_codes[symbols], green_sizes[symbols]
    if len(starts):
        far_codes, far_sizes = codes_of(lens[4])
        own, n = green_codes[256 + length_symbol], green_sizes[256 + length_symbol]
        for value, size in ((length_extra, length_size), (far_codes[far_symbol], far_sizes[far_symbol]), (far_extra, far_size)):
            own = own | value.astype(np.uint64) << n.astype(np.uint64)
            n = n + size
        order = np.argsort(np.concatenate([at, starts]), kind="stable")
        values, sizes = np.concatenate([values, own])[order], np.concatenate([sizes, n])[order]
    w.put_all(values, sizes)


def _guesses(lanes: np.ndarray, modes: list[int]) -> dict[int, np.ndarray]:
    """What each predictor mode expects, for all pixels but the first row and column; lanes: (height, width, 4) of int64."""
    left, top, corner = lanes[1:, :-1], lanes[:-1, 1:], lanes[:-1, :-1]
    right = np.concatenate([lanes[:-1, 2:], lanes[1:, :1]], axis=1)  # beyond the row's end lies this row's first pixel
    out = {0: np.broadcast_to(np.array([0, 0, 0, 255]), left.shape), 1: left, 2: top, 3: right, 4: corner, 7: (left + top) >> 1, 8: (corner + top) >> 1, 9: (top + right) >> 1, 12: np.clip(left + top - corner, 0, 255)}
    return {m: out[m] for m in modes}


def predict(pixels: np.ndarray, width: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The residuals of the pixels and the mode of each tile, the one whose residuals are smallest."""
    lanes = _lanes(pixels.reshape(-1, width)).astype(np.int64)
    height = len(lanes)
    across, down = -(-width // (1 << block)), -(-height // (1 << block))
    expected = np.zeros_like(lanes)
    expected[0, 0] = [0, 0, 0, 255]
    expected[0, 1:] = lanes[0, :-1]
    expected[1:, 0] = lanes[:-1, 0]
    modes = np.zeros(across * down, np.int64)
    if height > 1 and width > 1:
        options = _guesses(lanes, [0, 1, 2, 3, 4, 7, 8, 9, 12])
        tile = (np.arange(1, height)[:, None] >> block) * across + (np.arange(1, width) >> block)
        cost = [np.bincount(tile.ravel(), np.abs((lanes[1:, 1:] - x).astype(np.int8).astype(np.int64)).sum(axis=2).ravel(), across * down) for x in options.values()]
        best = np.argmin(cost, axis=0)
        modes = np.array(list(options))[best]
        stacked = np.stack(list(options.values()))
        expected[1:, 1:] = np.take_along_axis(stacked, best[tile][None, :, :, None], axis=0)[0]
    rest = ((lanes - expected) & 255).astype(np.uint8)
    return rest.reshape(-1, 4).copy().view("<u4")[:, 0].astype(np.uint32), modes


def _cross(pixels: np.ndarray, factors: tuple[int, int, int]) -> np.ndarray:
    """Red and blue less their shares of green, and blue less its share of red (in signed 32nds)."""
    green, red = _signed((pixels >> np.uint32(8)).astype(np.uint8)), ((pixels >> np.uint32(16)) & np.uint32(255)).astype(np.int64)
    to_red, to_blue, red_to_blue = factors
    blue = (pixels & np.uint32(255)).astype(np.int64) - ((to_blue * green) >> 5) - ((red_to_blue * _signed(red.astype(np.uint8))) >> 5)
    red = red - ((to_red * green) >> 5)
    return (pixels & np.uint32(0xFF00FF00)) | ((red & 255) << 16).astype(np.uint32) | (blue & 255).astype(np.uint32)


def _slope(of: np.ndarray, by: np.ndarray) -> int:
    x, y = _signed(by), _signed(of)
    x, y = x - x.mean(), y - y.mean()
    return int(np.clip(np.rint(32 * (x * y).sum() / max(1.0, (x * x).sum())), -127, 127))


def _image_bits(lanes: np.ndarray) -> float:
    return _bits(np.bincount((lanes + np.arange(4) * 256).ravel(), minlength=1024), np.full(4, len(lanes)))


def encode_image(pixels: np.ndarray, width: int) -> bytes:
    """Flat ARGB pixels as a lossless WebP file.

    Transforms are chosen by the entropy of what they leave: a palette, a predictor in tiles, subtracted green,
    cross-colour, or none; another must save a fiftieth and 200 bits.
    """
    height = len(pixels) // width
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1 + 3)  # alpha is used; the version is 0
    lanes = _lanes(pixels)
    costs = {"none": 0.98 * _image_bits(lanes) - 200}
    if costs["none"] > 0:
        if np.count_nonzero(np.bincount(((pixels * np.uint32(HASH)) >> np.uint32(22)).astype(np.int64))) <= 256:
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) <= 256 and len(colours) < len(pixels):
                costs["palette"] = _bits(np.bincount(index), np.array([len(pixels)])) + 24 * len(colours)
        if 5 * np.count_nonzero(lanes[1:] == lanes[:-1]) > lanes.size:  # neighbours are alike
            guess = lanes.copy()
            guess[1:] -= lanes[:-1]
            costs["predictor"] = _image_bits(guess)
        red, green = lanes[:, 2].astype(np.float32), lanes[:, 1].astype(np.float32)
        red -= red.mean()
        green -= green.mean()
        if 2 * (red @ green) ** 2 > (red @ red) * (green @ green):  # red goes with green
            factors = (_slope(lanes[:, 2], lanes[:, 1]), _slope(lanes[:, 0], lanes[:, 1]), 0)
            made = {"green": _cross(pixels, (32, 32, 0)), "cross-colour": _cross(pixels, factors)}
            costs |= {k: _image_bits(_lanes(x)) + 60 * (k != "green") for k, x in made.items()}
    best = min(costs, key=costs.get)
    now = width
    if best == "palette":
        w.put(1 | 3 << 1, 3)
        w.put(len(colours) - 1, 8)
        own = _lanes(colours).copy()
        own[1:] -= _lanes(colours)[:-1]
        put_image(w, own.view("<u4")[:, 0].astype(np.uint32))
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        now = -(-width // (1 << pack))
        grid = np.zeros((height, now << pack), np.uint32)
        grid[:, :width] = index.reshape(height, width)
        grid = grid.reshape(height, now, 1 << pack) << (np.arange(1 << pack, dtype=np.uint32) * np.uint32(8 >> pack))
        pixels = (grid.sum(axis=2, dtype=np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).ravel()
    elif best == "predictor":
        block = 4
        pixels, modes = predict(pixels, width, block)
        w.put(1 | 0 << 1 | (block - 2) << 3, 6)
        put_image(w, modes.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000))
    elif best == "green":
        pixels = made["green"]
        w.put(1 | 2 << 1, 3)
    elif best == "cross-colour":
        pixels = made["cross-colour"]
        block = 9
        tiles = -(-width // (1 << block)) * -(-height // (1 << block))
        w.put(1 | 1 << 1 | (block - 2) << 3, 6)
        put_image(w, np.full(tiles, 0xFF000000 | (factors[2] & 255) << 16 | (factors[1] & 255) << 8 | factors[0] & 255, np.uint32))
    w.put(0, 1)
    put_image(w, pixels, main=True)
    body = w.done()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode_samples(payload: bytes) -> bytes:
    """A lossless WebP file whose samples, in the order green, red, blue, alpha, are the payload. Rows that the payload
    doesn't fill are padded with its first byte."""
    width, height = dimensions(len(payload))
    data = np.frombuffer(payload, np.uint8)
    if (missing := width * height * 4 - len(data)) > 0:
        data = np.concatenate([data, np.full(missing, data[0])])
    lanes = np.ascontiguousarray(data.reshape(-1, 4)[:, [2, 0, 1, 3]])
    return encode_image(lanes.view("<u4")[:, 0].astype(np.uint32), width)


def samples_of(pixels: np.ndarray) -> np.ndarray:
    """Green, red, blue and alpha of each pixel, in that order."""
    return _lanes(pixels)[:, [1, 2, 0, 3]].ravel()


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


def feature(samples: np.ndarray) -> str:
    """Mean and variance of the samples, the entropy of their histogram, and a 64-bit print of block means."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    levels = np.arange(256)
    mean = int((counts * levels).sum()) / len(samples)
    var = int((counts * levels * levels).sum()) / len(samples) - mean * mean
    edges = np.arange(64) * len(samples) // 64
    blocks = np.add.reduceat(samples, edges, dtype=np.int64) / np.diff(np.append(edges, len(samples)))
    return f"{mean:.4f},{var:.4f},{-(share * np.log2(share)).sum():.4f},{np.packbits(blocks > mean).tobytes().hex()}"


def text_to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text, padded with bytes 0 to a positive multiple of 64, as a lossless WebP file."""
    kind = dict(df.dtypes)[id_col]

    def store(batches):
        for batch in sliced(batches, 1):
            texts = byte_texts(batch.column(1))
            payloads = [padded(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(len, payloads), pa.int64()), pa.array(map(encode_samples, payloads), pa.binary())],
                names=[id_col, "n_bytes", "payload_bytes", "media"],
            )

    return on_texts(df.select(F.col(id_col), F.col(text_col)), store, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, media binary")


def decode_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), pixels: bool = True) -> DataFrame:
    """Decode a column of lossless WebP files into pixel arrays and digests.

    payload_bytes, where kept, bounds the samples that belong to the payload. pixels=False leaves the arrays out.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "width int, height int", *(["pixels binary"] * pixels), "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, method string, error string"])
    names = [*keep, "width", "height", *(["pixels"] * pixels), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "method", "error"]
    types = [pa.int32(), pa.int32(), *([pa.binary()] * pixels), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    bound = keep.index("payload_bytes") if "payload_bytes" in keep else None

    def one(data: bytes | None, limit: int | None) -> tuple:
        nothing = (None,) * (4 + pixels)
        if data is None:
            return (*nothing, None, None, None, None, "null")
        met: set[str] = set()
        try:
            width, height, argb = decode(data, met)
        except MediaError as e:
            return (*nothing, len(data), hashlib.sha256(data).hexdigest(), None, None, str(e))
        samples = samples_of(argb)[:limit]
        body = samples.tobytes()
        own = (argb.astype("<u4").tobytes(),) if pixels else ()
        return (width, height, *own, hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples), ", ".join(sorted(met)), None)

    def read(batches):
        for part in sliced(batches, len(keep), 1 << 20):
            limits = [None] * part.num_rows if bound is None else part.column(bound).to_pylist()
            rows = [one(*x) for x in zip(part.column(len(keep)).to_pylist(), limits, strict=True)]
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *made], names=names)

    return on_texts(df.select(*(F.col(k) for k in keep), F.col(media_col)), read, schema)

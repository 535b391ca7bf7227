"""Image tables: PNG decoding with the standard library, difference hashes, and harvest rules."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from dialoom.functions.text import col, strip
from dialoom.operators.filters import large_enough, passes_terms

Decoder = Callable[[bytes], np.ndarray]


def decode_png(data: bytes) -> np.ndarray:
    """Rows x columns x channels of an 8-bit PNG that isn't interlaced. Palettes are resolved."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, palette = 8, [], None
    width = height = depth = kind = laced = 0
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind, 0)
    if depth != 8 or laced or not channels:
        raise ValueError("unsupported PNG")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    for y in range(height):
        line, above = raw[y, 1:].astype(int), out[y - 1].astype(int) if y else np.zeros(width * channels, int)
        how = raw[y, 0]
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = (line + above) & 255
        else:
            row = out[y]
            for x in range(width * channels):
                left = int(row[x - channels]) if x >= channels else 0
                corner = int(above[x - channels]) if x >= channels else 0
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + int(above[x])) // 2
                else:
                    p = left + int(above[x]) - corner
                    by = [abs(p - left), abs(p - int(above[x])), abs(p - corner)]
                    guess = (left, int(above[x]), corner)[by.index(min(by))]
                row[x] = (int(line[x]) + guess) & 255
    out = out.reshape(height, width, channels)
    return palette[out[:, :, 0]] if kind == 3 and palette is not None else out


def grey(pixels: np.ndarray) -> np.ndarray:
    """8-bit luma of the colour channels, in 16-bit fixed point."""
    x = pixels.astype(np.int64)
    if x.shape[2] < 3:
        return x[:, :, 0]
    return (x[:, :, 0] * 19595 + x[:, :, 1] * 38470 + x[:, :, 2] * 7471 + 0x8000) >> 16


def lanczos_weights(size: int, cells: int) -> np.ndarray:
    """Weights (cells, size) of a windowed sinc of three lobes, widened to the scale where it shrinks, in 22-bit fixed point."""
    scale = size / cells
    wide = max(scale, 1.0)
    out = np.zeros((cells, size), np.int64)
    for k in range(cells):
        centre = (k + 0.5) * scale
        first, end = max(0, int(centre - 3 * wide + 0.5)), min(size, int(centre + 3 * wide + 0.5))
        at = (np.arange(first, end) - centre + 0.5) / wide
        weight = np.where(np.abs(at) < 3, np.sinc(at) * np.sinc(at / 3), 0)
        out[k, first:end] = np.floor(weight / weight.sum() * (1 << 22) + 0.5)
    return out


def resized(grey_pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """An 8-bit image at another size: columns first, then rows, each rounded to 8 bits."""
    across = np.clip((grey_pixels @ lanczos_weights(grey_pixels.shape[1], columns).T + (1 << 21)) >> 22, 0, 255)
    return np.clip((lanczos_weights(grey_pixels.shape[0], rows) @ across + (1 << 21)) >> 22, 0, 255)


def dhash(pixels: np.ndarray) -> int:
    """64 bits, row by row from the lowest: a cell is brighter than its left neighbour, on a grid of 8 x 9."""
    cells = resized(grey(pixels), 8, 9)
    value = sum(1 << int(k) for k in np.flatnonzero((cells[:, 1:] > cells[:, :-1]).ravel()))
    return value - (1 << 64) if value >> 63 else value


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of rows x columns x channels (1, 3 or 4)."""
    height, width, channels = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def described(content: Column | str, decoder: Decoder = decode_png) -> Column:
    """struct<width, height, dhash> of image bytes; nulls where the decoder fails."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for data in x:
                try:
                    p = decoder(bytes(data))
                    out.append((p.shape[1], p.shape[0], dhash(p)))
                except (ValueError, TypeError, zlib.error, struct.error):
                    out.append((None, None, None))
            yield pd.DataFrame(out, columns=["width", "height", "dhash"]).astype({"width": "Int32", "height": "Int32", "dhash": "Int64"})

    kind = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("dhash", LongType())])
    return F.pandas_udf(run, kind)(col(content))


def harvest_verdicts(items: DataFrame, seen: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), least_width: int = 0, least_height: int = 0, url: str = "url", text: str = "text") -> DataFrame:
    """Add `reason`: seen, too_small, no_prompt, terms or kept."""
    known = seen.select(F.col(url)).distinct().withColumn("_seen", F.lit(True))
    reason = (
        F.when(F.col("_seen"), "seen").when(~large_enough("width", "height", least_width, least_height), "too_small")
        .when(strip(F.coalesce(F.col(text), F.lit(""))) == "", "no_prompt").when(~passes_terms(text, include, exclude), "terms").otherwise("kept")
    )
    return items.join(known, url, "left").withColumn("reason", reason).drop("_seen")

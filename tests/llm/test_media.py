from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import webp_writer
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.llm import media


def picture(width, height, colours, seed):
    rng = random.Random(seed)
    table = [rng.getrandbits(32) for _ in range(colours)]
    out = []
    for k in range(width * height):
        out.append(out[k - width] if k >= width and rng.random() < 0.5 else out[-1] if k and rng.random() < 0.4 else rng.choice(table))
    return out


@pytest.mark.parametrize("steps", [(), ("green",), ("predictor",), ("cross",), ("palette",), ("predictor", "cross", "green"), ("palette", "predictor"), ("green", "cross", "predictor")])
@pytest.mark.parametrize(("cache", "groups"), [(0, False), (4, False), (0, True), (11, True)])
@pytest.mark.parametrize(("width", "height", "colours"), [(1, 1, 1), (13, 9, 2), (17, 11, 4), (9, 30, 15), (33, 20, 200)])
def test_decodes_what_the_writer_wrote(steps, cache, groups, width, height, colours):
    pixels = picture(width, height, colours, width + colours)
    data = webp_writer.encode(pixels, width, steps, seed=cache + width, cache_bits=cache, groups=groups)
    w, h, found = media.decode(data)
    assert (w, h) == (width, height)
    assert found.tolist() == pixels


@pytest.mark.parametrize("modes", [0, 1])
def test_uniform_predictors_have_the_same_result_as_the_general_path(modes):
    rng = np.random.default_rng(modes)
    pixels = rng.integers(0, 1 << 32, 60, np.uint32)
    fast = media.invert_predictor(pixels, 10, 6, np.full(6, modes), 2)
    rows = media._lanes(pixels.reshape(6, 10)).tolist()
    for y in range(6):
        for x in range(10):
            if y == 0:
                g = rows[0][x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                g = rows[y - 1][0]
            else:
                g = media.predicted(modes, rows[y][x - 1], rows[y - 1][x], rows[y - 1][min(9, x + 1)], rows[y - 1][x - 1])
            rows[y][x] = [(a + b) & 255 for a, b in zip(rows[y][x], g, strict=True)]
    assert fast.tolist() == [a | b << 8 | c << 16 | d << 24 for r in rows for a, b, c, d in r]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700))
def test_samples_round_trip(data):
    payload = media.padded(data)
    stored = media.encode_samples(payload)
    assert media.samples_of(media.decode(stored)[2])[: len(payload)].tobytes() == payload


@pytest.mark.parametrize("size", [64 * 16384, 64 * 16385, 3 << 20])
def test_long_payloads(size):
    payload = media.padded(np.random.default_rng(1).integers(0, 200, size, np.uint8).tobytes())
    assert media.samples_of(media.decode(media.encode_samples(payload))[2])[: len(payload)].tobytes() == payload


def test_broken_files_are_named():
    good = media.encode_samples(media.padded(b"hello"))
    for bad in (b"", b"RIFF", good[:-10], b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0", good[:20] + b"\0" + good[21:]):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_column_operators(spark):
    long = "é" * 300_000
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "abc", "c"), (3, "abc", "c"), (4, long, "c"), (None, "x", "c")], "doc_id long, text string, media string")
    rows = media.decode_media(media.text_to_media(df), keep=("doc_id", "n_bytes", "payload_bytes")).collect()
    assert len(rows) == 6
    for r, text in zip(rows, ["", "", "abc", "abc", long, "x"], strict=True):
        payload = media.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.pixels) == 4 * r.width * r.height and r.error is None
    assert rows[2][1:] == rows[3][1:]
    assert media.text_to_media(df.limit(0)).count() == 0
    broken = spark.createDataFrame([(b"no",), (None,)], "media binary")
    assert [r.error for r in media.decode_media(broken).collect()] == ["no WebP file", "null"]


def reports(texts):
    """The parts of the format by which each text is stored."""
    found = []
    for text in texts:
        payload, met = media.padded(text.encode()), set()
        assert media.samples_of(media.decode(media.encode_samples(payload), met)[2])[: len(payload)].tobytes() == payload
        found.append(met)
    return found


def tinted(seed, share, n=3000):
    """Pixels whose red and blue go with their green."""
    rng = random.Random(seed)
    return "".join(chr(g) + "".join(chr(int(g * x) + rng.randrange(3)) for x in share) + rng.choice("xyz") for g in rng.choices(range(8, 120), k=n))


GREY, TINTED = tinted(1, (1, 1)), tinted(2, (0.5, 0.25))
def walk(seed, n=3000):
    """Pixels each of whose samples differs by one at most from that before."""
    rng, now, out = random.Random(seed), [70] * 4, []
    for _ in range(n):
        now = [min(126, max(33, x + rng.choice((-1, 0, 0, 1)))) for x in now]
        out += now
    return bytes(out).decode()


STEPS = walk(6)
FEW = "".join(random.Random(3).choices(["abcd", "efgh", "ijkl", "mnop", "qrst"], k=3000))
OFTEN = "".join(random.Random(7 * k).choice([f"{random.Random(k % 40).randrange(1000, 10000)}", "".join(random.Random(k).choices("abcdefghijklmnop", k=4))]) for k in range(6000))
PROSE = " ".join(random.Random(4).choices([f"word{k}" for k in range(50)], k=4000))


def test_streams_hold_each_part_where_it_shortens_them():
    assert "green" in reports([GREY])[0]
    assert "cross-colour" in reports([TINTED])[0]
    assert "predictor" in reports([STEPS])[0]
    assert "palette" in reports([FEW])[0]
    assert {"prefix codes", "back-references"} <= reports([PROSE + PROSE])[0]
    assert "cache" in reports([OFTEN])[0]


def test_the_query_reads_such_streams_and_writes_pixels(spark, tmp_path):
    from dialoom.llm import queries

    texts = [GREY, TINTED, STEPS, FEW, PROSE + PROSE, OFTEN, "", None, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.QUERIES["op2_media_columns"](spark, str(tmp_path)).collect()}
    met = set()
    for k, text in enumerate(texts):
        payload, r = media.padded((text or "").encode()), rows[k]
        argb = np.frombuffer(r.pixels, "<u4")
        assert media.samples_of(argb)[: len(payload)].tobytes() == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None)
        met |= set(r.method.split(", "))
    assert {"prefix codes", "back-references", "cache", "palette", "predictor", "cross-colour", "green"} <= met


def test_both_readers_agree():
    """The reader that follows one chain of tokens gives what the one for streams with an entropy image gives."""
    for text in (GREY, TINTED, STEPS, FEW, PROSE, OFTEN):
        pixels = media.decode(media.encode_samples(media.padded(text.encode())))[2].tolist()[:400]
        for groups in (False, True):
            assert media.decode(webp_writer.encode(pixels, 20, (), seed=3, cache_bits=5, groups=groups))[2].tolist() == pixels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 0xFF000000, 0xFF0A0A0A, 0x80402010, 0xFFFFFFFF]), min_size=1, max_size=300), st.integers(1, 20))
def test_images_round_trip(pixels, width):
    pixels = pixels[: max(1, len(pixels) // width) * width] if len(pixels) >= width else pixels[:1] * width
    assert media.decode(media.encode_image(np.array(pixels, np.uint32), width))[2].tolist() == pixels

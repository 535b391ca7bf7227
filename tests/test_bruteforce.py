"""Queries without SQL against plain Python over the same tables."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter, deque

import numpy as np
import pandas as pd
import pytest

from dialoom.functions import hashing
from dialoom.functions.text import UNWANTED_CLASS, UNWANTED_RANGES
from dialoom.functions.turns import nest
from dialoom.operators import dedup, images, ngrams, plugins
from dialoom.plans import chat_queries, io_queries, text_queries

ALL = chat_queries.REG.queries | text_queries.REG.queries | io_queries.REG.queries


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: ALL[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def chats(spark, sf_dir):
    found = nest(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    return {r.conv_id: [(t["from"], t["value"]) for t in r.turns] for r in found}


def walk(names, like):
    """(leader, member) of one ordered walk over all pairs."""
    leaders, out = [], set()
    for x in names:
        leader = next((a for a in leaders if like(a, x)), None)
        if leader is None:
            leaders.append(x)
        else:
            out.add((leader, x))
    return out


def test_near_duplicates(run, rows):
    docs = {r.doc_id: r.text for r in rows("documents") if r.text}
    code = {k: (hashing.simhash64_of(x) % (1 << 64)) >> 48 for k, x in docs.items()}
    sig = dict(zip(docs, map(np.array, dedup.signature.func(pd.Series(list(docs.values())))), strict=True))
    like = lambda a, b: code[a] == code[b] and (sig[a] == sig[b]).mean() >= 0.9
    expected = walk(sorted(docs), like)
    assert expected and {(r.leader, r.member) for r in run("neardup_dedup")} == expected


def test_perceptual_groups(run, rows):
    code = {r.doc_id: hashing.simhash64_of(r.text or "") % (1 << 64) for r in rows("documents")}
    like = lambda a, b: code[a] >> 48 == code[b] >> 48 and (code[a] ^ code[b]).bit_count() <= 8
    assert {(r.leader, r.member) for r in run("perceptual_groups")} == walk(sorted(code), like)


def test_simhash_is_the_plain_one():
    import hashlib

    for text in ("", "hello", "hello world", "Hello  WORLD hello", "a b c a"):
        sums = [0] * 64
        for w, n in Counter(text.lower().split()).items():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "big")
            for k in range(64):
                sums[k] += n if h >> k & 1 else -n
        assert hashing.simhash64_of(text) % (1 << 64) == sum(1 << k for k in range(64) if sums[k] > 0)
    assert hashing.simhash64_of("hello") % (1 << 64) == 13362634815750784402


def test_minhash_estimates(run, rows):
    sets = {r.item_id: {r.text[k : k + 3] for k in range(max(1, len(r.text) - 2))} for r in rows("benchmark") if r.text}
    exact = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    found = {(r.a, r.b) for r in run("minhash_estimates")}
    sure = {p for p, j in exact.items() if j >= 0.3}
    assert len(found & sure) >= 0.9 * len(sure) and all(exact[p] > 0.08 for p in found)


def test_ngrams_with_recency(spark, sf_dir, run):
    grams = ngrams.ngrams(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").select("n", "ngram", "pos.o", "pos.place").collect()
    for n in (3, 4, 5):
        last, counts, first = deque(maxlen=50), Counter(), {}
        for r in sorted((r for r in grams if r.n == n), key=lambda r: (r.o, r.place)):
            s = frozenset(r.ngram)
            if all(len(s & x) / max(1, len(s | x)) < 0.85 for x in last):
                last.append(s)
                counts[" ".join(r.ngram)] += 1
                first.setdefault(" ".join(r.ngram), (r.o, r.place))
        expected = sorted(counts, key=lambda g: (-counts[g], first[g]))[:10]
        assert [(r.ngram, r.cnt) for r in sorted(run("ngram_recency"), key=lambda r: r["rank"]) if r.n == n] == [(g, counts[g]) for g in expected]


def test_recency_with_a_low_threshold(spark):
    df = spark.createDataFrame([(0, "a b c d e f a b c x"), (1, "a b d c")], "o long, text string")
    grams = ngrams.ngrams(df, "o", "text", 3, 3, stop_limit=3, punct_limit=3)
    assert [r.ngram for r in ngrams.with_recency(grams, 50, 0.5).collect()] == [["a", "b", "c"], ["c", "d", "e"], ["e", "f", "a"]]


def test_shuffle(run, rows):
    said = [(r.conv_id, r.turn) for r in run("shuffle_seeded")]
    assert sorted(said) == sorted((r.conv_id, r.turn) for r in rows("conversations")) and said != sorted(said)
    assert said == [(r.conv_id, r.turn) for r in run("shuffle_seeded")]


def test_shuffle_does_not_depend_on_partitions(spark, sf_dir):
    from dialoom.operators import reshape

    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    assert reshape.shuffled(df.repartition(7), 5, "conv_id", "turn").collect() == reshape.shuffled(df.coalesce(1), 5, "conv_id", "turn").collect()


def test_json_in_fences(spark, sf_dir, run):
    of = {r.conv_id: r.m for r in chat_queries.listed(spark, sf_dir).collect()}
    dumped = lambda m: json.dumps([{k: v for k, v in x.asDict().items() if v is not None} for x in m], ensure_ascii=False, separators=(",", ":"))
    assert {r.conv_id: r.chars for r in run("json_fence_extract")} == {k: len(dumped(m)) for k, m in of.items()}


def test_scored_sentences(run, rows):
    model = plugins.lexicon_scorer(["tion", "the", "erth"])
    for r in run("scored_sentences"):
        text = next(x.text for x in rows("benchmark") if x.item_id == r.item_id)
        said = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        positive = sum(x > 0.6 for x in model(said))
        assert (r.n, r.n_positive, r.kept) == (len(said), positive, not said or positive / len(said) <= 0.55)


def test_language_filter(run, chats):
    unwanted = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNWANTED_RANGES) + "]")
    assert UNWANTED_CLASS.startswith("[\\x{00C0}-\\x{017F}")
    for r in run("language_filter"):
        said = " ".join(v for f, v in chats[r.conv_id] if f == "gpt").replace("\n", " ")
        label, share = plugins.frequent_word_language([said])[0]
        assert r.verdict == ("kept" if label == "en" and share >= 0.69 and not unwanted.search(said) else "rejected")


def test_tokens_of_rows(run, rows):
    model = plugins.hashed_tokenizer()
    of = {r.doc_id: model([r.text])[0] for r in rows("documents")}
    assert {r.doc_id: r.input_ids for r in run("tokenize_rows")} == of
    assert all(r.attention_mask == [1] * len(r.input_ids) for r in run("tokenize_rows"))


def test_corrected_replies(run, chats):
    model = plugins.rule_corrector()
    for r in run("corrected_replies"):
        assert [(t["from"], t["value"]) for t in r.turns] == [(f, model([v])[0] if f == "gpt" else v) for f, v in chats[r.conv_id]]


def test_improved_messages(run, chats, spark, sf_dir):
    pair = [("user", "a"), ("assistant", "b")]
    improved = {r.conv_id: r.improved for r in run("improved_messages")}
    for k, turns in chats.items():
        if len(turns) != 2:
            assert improved[k] is None
        elif improved[k] is not None:
            assert [(m.role, m.content) for m in improved[k]] == pair


def test_processed_entries(run, chats):
    order = sorted(chats)
    for r in run("processed_entries"):
        at = order.index(r.conv_id) + 1
        two = len(chats[r.conv_id]) == 2
        assert at <= 50
        assert r.reason == (None if at < 3 or two else "no answer")
        assert [m.content for m in r.result] == (["Be kind.", "a", "b"] if at >= 3 and two else [v for _, v in chats[r.conv_id]])


def test_embedded_texts(run, rows):
    model = plugins.hashed_embedder()
    of = {r.item_id: model([r.text])[0] for r in rows("benchmark")}
    for r in run("embedded_texts"):
        assert np.allclose(r.vector, of[r.item_id], atol=1e-6)


def plain_lanczos(x, rows, columns):
    """Resampling cell by cell, in plain floats, rounded to 8 bits after each direction."""

    def line(values, cells):
        scale = len(values) / cells
        wide, out = max(1.0, scale), []
        for k in range(cells):
            centre = (k + 0.5) * scale
            total = weight = 0.0
            for j in range(max(0, int(centre - 3 * wide + 0.5)), min(len(values), int(centre + 3 * wide + 0.5))):
                t = (j + 0.5 - centre) / wide
                w = 0.0 if abs(t) >= 3 else 1.0 if t == 0 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2
                total, weight = total + w * values[j], weight + w
            out.append(min(255, max(0, math.floor(total / weight + 0.5))))
        return out

    across = [line(r, columns) for r in x]
    down = [line([r[c] for r in across], rows) for c in range(columns)]
    return [[down[c][r] for c in range(columns)] for r in range(rows)]


def test_difference_hashes(run, rows):
    of = {r.doc_id: r for r in run("difference_hashes")}
    texts = {r.doc_id: r.text for r in rows("documents")}
    for k in sorted(texts)[:40]:
        x = np.resize(np.frombuffer((texts[k] or " ").encode()[:4096] or b" ", np.uint8), (24, 31)).tolist()
        cells = plain_lanczos(x, 8, 9)
        close = sum(abs(cells[r][c + 1] - cells[r][c]) <= 1 for r in range(8) for c in range(8))
        bits = sum(1 << (8 * r + c) for r in range(8) for c in range(8) if cells[r][c + 1] > cells[r][c])
        assert (of[k].width, of[k].height) == (31, 24)
        assert (bits ^ (of[k].dhash % (1 << 64))).bit_count() <= close  # fixed point may round a tie the other way
    by = {}
    for k, t in texts.items():
        assert by.setdefault(t, of[k].dhash) == of[k].dhash


def test_png_round_trip():
    rng = np.random.default_rng(1)
    for channels in (1, 3, 4):
        x = rng.integers(0, 256, (7, 5, channels), np.uint8)
        assert (images.decode_png(images.encode_png(x)) == x).all()


def test_captioned_images(run, rows):
    found = sorted(run("captioned_images"), key=lambda r: r["index"])
    paths = sorted(f"{r.item_id}.png" for r in rows("benchmark"))
    done = [p for p in paths if p < "2"]
    assert [r.path for r in found] == [p for p in paths if p not in done]
    start = max(map(len, done)) + 1
    assert [r["index"] for r in found] == list(range(start, start + len(found)))
    counts = Counter(r.prompt for r in found)
    assert set(counts) == {"short", "long", "plain"} and max(counts.values()) - min(counts.values()) <= 2
    assert all(0.5 <= r.temperature <= 1 and round(r.temperature, 2) == r.temperature and r.caption.startswith(r.prompt) for r in found)


def test_streamed_generations(run):
    for r in run("streamed_generations"):
        if r.doc_id % 5 == 1:
            assert (r.said, r.outcome) == (None, "incomplete")
        else:
            closed = r.said.count("</a>")
            assert "Upon" not in r.said and r.outcome in ("stopped", "ended") and (closed == 10 if r.outcome == "ended" else 2 <= closed)
    assert {r.outcome for r in run("streamed_generations")} == {"stopped", "ended", "incomplete"}


def test_streams_that_always_refuse(spark):
    from dialoom.operators import generation

    out = generation.streamed(spark.range(3), lambda name, attempt: iter(["x", "shivers down"]), "id", {"human": ("<u>", "</u>"), "gpt": ("<a>", "</a>")}).collect()
    assert {(r.said, r.outcome) for r in out} == {(None, "abandoned")}


def test_search_finds_the_nearest_of_all(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "i long, v array<double>").repartition(5)
    found = {(r.a, r["rank"]): r.b for r in dedup.searched(df.where("i % 100 = 0"), df, "i", "v", 3, block=2).collect()}
    for q in range(0, 500, 100):
        sims = np.round(x @ x[q], 6)
        sims[q] = -np.inf
        assert [found[q, k] for k in (1, 2, 3)] == np.lexsort((np.arange(500), -sims))[:3].tolist()


@pytest.mark.parametrize("least", [0.85, 0.97])
def test_cosine_pairs_have_their_recall(spark, least):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0.05, 0.15, 0.3, 0.5)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    exact = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if sims[a, b] >= least}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "i long, v array<double>")
    found = {(r.a, r.b) for r in dedup.cosine_pairs(df, "i", "v", least).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) > 50


def test_every_pair_of_sets_and_codes_is_found(spark):
    rng = random.Random(5)
    sets = [[f"x{rng.randrange(12)}" for _ in range(rng.randrange(9))] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(sets)), "i long, s array<string>")
    for least in (0.3, 0.6, 1.0):
        exact = {(a, b) for a in range(80) for b in range(a + 1, 80) if sets[a] and sets[b] and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= least}
        assert {(r.a, r.b) for r in dedup.jaccard_pairs(df, "i", "s", least).collect()} == exact
    codes = [rng.getrandbits(64) for _ in range(30)]
    codes += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in codes]
    df = spark.createDataFrame([(k, c - (1 << 64) if c >> 63 else c) for k, c in enumerate(codes)], "i long, c long")
    exact = {(a, b, (codes[a] ^ codes[b]).bit_count()) for a in range(60) for b in range(a + 1, 60) if (codes[a] ^ codes[b]).bit_count() <= 8}
    assert {tuple(r) for r in dedup.hamming_pairs(df, "i", "c", 8).collect()} == exact

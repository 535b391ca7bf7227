"""Small tables with nulls, empty and long texts, ties, repeated rows, no rows, and columns whose names clash."""

from __future__ import annotations

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dialoom.llm import chat, decontaminate, html_text, language_model, licenses, neardup, packing, quality, sharding

CLASHING = "row long, id long, key string, n long, hub string, label int, part int, pos long, rank int, size long, set_key string, bands string, component string, hits string, found string, base double"


def documents(spark, rows):
    """doc_id and text, among columns that operators use names of."""
    extra = (7, 7, "k", 7, "h", 7, 7, 7, 7, 7, "s", "b", "c", "h", "f", 0.5)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], f"doc_id long, text string, {CLASHING}")


LONG = " ".join(f"word{k % 977}" for k in range(60_000))
EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "a b c"), (4, "a b c"), (5, LONG), (6, "a b c"), (None, "no id here"), (7, "é" * 70 + " ü"), (8, "one two three four five six seven eight nine ten")]


# Packing


def test_ids_are_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", " ", "　", "a", "don't", "x1", "é", "...", " the", "\x1c", "\x85", "!?", "<|endoftext|>", "\U0001f600", "\r\n", "́", "12 3", "​", "﻿"]
    own = packing.encoder()
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert own.encode(text).tolist() == known.encode(text, add_special_tokens=False).ids, repr(text)


def test_first_fit_decreasing_is_the_plain_one():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 700):
        sizes = rng.integers(1, 65, n)
        free, expected = [], np.zeros(n, int)
        for k in np.argsort(-sizes, kind="stable"):
            at = next((b for b, f in enumerate(free) if f >= sizes[k]), len(free))
            if at == len(free):
                free.append(64)
            expected[k] = at
            free[at] -= sizes[k]
        bins, offsets = packing.first_fit_decreasing(sizes, 64)
        assert bins.tolist() == expected.tolist()
        assert all(offsets[k] + sizes[k] <= 64 for k in range(n))


def check_packed(rows, texts, length=1024):
    """Every id of every row lies in one piece, and pieces fill their sequences without gaps."""
    own = packing.encoder()
    arrays = [np.append(own.encode(t or ""), np.uint32(0)).astype("<u4") for _, t in texts]
    wanted = Counter((i, s, len(a[s : s + length]), zlib.crc32(a[s : s + length]), len(a)) for (i, _), a in zip(texts, arrays, strict=True) for s in range(0, len(a), length))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    return sum(n for p in sequences.values() for _, n in p) / (length * len(sequences))


def test_packing_edges(spark):
    check_packed(packing.pack_documents(documents(spark, EDGES)).collect(), EDGES)
    assert packing.pack_documents(documents(spark, [])).count() == 0
    with_ids = packing.pack_documents(documents(spark, [(1, "hello world")]), ids=True).first()
    assert list(with_ids.ids)[-1] == 0 and len(with_ids.ids) == with_ids.length


def test_packing_is_tight(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, group_size=100_000).collect()
    assert check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()]) > 0.95


# Quality


def test_trees_in_arrays_score_as_walked():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit_trees(x, y, rounds=40)

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] >= 0:
                at = trees.left[at] + int(row[trees.feature[at]] > trees.threshold[at])
            total += trees.value[at]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.95


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0, 9), (5, 0, 0, 9), (None, 1, 0, 9), (8, None, 0, 9)], "doc_id long, quality int, toxic int, text int")
    rows = quality.quality_scores(documents(spark, EDGES), labels).collect()
    assert len(rows) == len(EDGES)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.doc_id: r.held_out for r in rows} == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in EDGES}
    assert quality.quality_scores(documents(spark, []), labels).count() == 0
    assert {r.score for r in quality.quality_scores(documents(spark, EDGES), labels.limit(0)).collect()} == {0.5}
    assert set(quality.keep_good(documents(spark, EDGES), labels).columns) == set(documents(spark, []).columns)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = quality.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = scores.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93


# Near-duplicates


def expected_components(rows, percent):
    sets = [(i, frozenset(neardup.shingles((t or "").encode()).tolist())) for i, t in rows]
    above = {}

    def find(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if s and t and a < b and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                above[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def edited(words, rng, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [80, 85])
def test_components_are_those_of_all_pairs(spark, percent):
    rng = random.Random(percent)
    rows = []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(rng.choice([4, 6, 40, 150]))]
        rows += [" ".join(base)] * rng.choice([0, 1, 3])
        rows += [edited(base, rng, rng.choice([1, 2, 3, 5, 8])) for _ in range(rng.choice([1, 4, 25]))]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    found = {r.doc_id: r for r in neardup.near_duplicates(documents(spark, rows), percent=percent).collect()}
    assert {i: r.component_id for i, r in found.items()} == expected_components(rows, percent)
    assert all(r.kept == (i == r.component_id) for i, r in found.items())


def test_families_without_their_original(spark):
    """Members share buckets without being linked to the hub; the exact remainder finds all links between them."""
    rng = random.Random(5)
    rows = []
    for family in range(4):
        base = [f"w{family}x{k}" for k in range(120)]
        rows += [edited(base, rng, 3) for _ in range(40)]
        rows += [edited(rows[-1].split(), rng, 1) for _ in range(8)]
    rows = list(enumerate(rows))
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, rows), percent=85).collect()}
    assert found == expected_components(rows, 85)


def test_near_duplicate_edges(spark):
    rows = neardup.near_duplicates(documents(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[6] == (1, 4, False) and by[None] == (1, None, True)
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    kept = neardup.keep_one(documents(spark, EDGES))
    assert kept.columns == documents(spark, []).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, None, 7, 8])


def test_rows_with_one_id_go_by_their_texts(spark):
    base = [f"w{k}" for k in range(100)]
    near = [*base[:-1], "end"]
    copy, unique = "a copied text of some words", "a unique text that stands alone"
    texts = [(3, copy), (5, copy), (5, unique), (8, " ".join(base)), (8, " ".join(near)), (8, "quite other words here"), (9, "quite  other words here"), (10, "twice"), (10, "twice"), (11, None), (11, None), (11, "not null")]
    kept = neardup.keep_one(documents(spark, texts)).collect()
    found = Counter((r.doc_id, r.text) for r in kept)
    assert sum(found.pop((8, " ".join(x)), 0) for x in (base, near)) == 1
    assert found == Counter([(3, copy), (5, unique), (8, "quite other words here"), (10, "twice"), (11, None), (11, "not null")])


def test_sketches_estimate_jaccard():
    rng = np.random.default_rng(4)
    sketcher = neardup.Sketcher(128, 1)
    for n in (3, 20, 400):
        shared, alone = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64)
        a, b = np.sort(shared), np.sort(np.concatenate([shared, alone]))
        same = (sketcher.bands(a) == sketcher.bands(b)).mean()
        assert abs(same - 0.5) < 0.3
        assert (sketcher.bands(a) == sketcher.bands(a.copy())).all()


# Decontamination

ITEM = "the quick brown fox jumps over the lazy dog while seven old owls watch from trees"


def test_contamination_cases(spark):
    items = spark.createDataFrame([(1, ITEM, 0), (2, "alpha beta", 0), (3, None, 0), (4, "?!", 0), (1, ITEM, 0)], "item_id long, text string, id int")
    words = ITEM.split()
    texts = [
        (1, None), (2, ""), (3, "nothing to see here " * 20), (4, ITEM.upper()), (4, ITEM.upper()), (5, "x " * 30 + " ".join(words[:13]) + " y" * 30),
        (6, " ".join(words[:12])), (7, "alpha, BETA! " + "z " * 37), (8, "alpha beta " + "z " * 39), (None, ITEM), (9, LONG), (10, " ".join(words[1:14]) + " alpha"),
    ]
    expected = {1: (0, 0, 0, False), 2: (0, 0, 0, False), 3: (80, 0, 0, False), 4: (16, 16, 1, True), 5: (73, 13, 1, True), 6: (12, 0, 0, False), 7: (39, 2, 1, True), 8: (41, 2, 1, False), None: (16, 16, 1, True), 9: (60_000, 0, 0, False), 10: (14, 13, 1, True)}
    for blocks in ({}, {"block_shingles": 5, "block_windows": 2}):  # in one pass, and in many
        rows = decontaminate.contamination(documents(spark, texts), items, **blocks).collect()
        assert len(rows) == len(texts)
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows} == expected
        assert {r.items_sha256 for r in rows if r.doc_id in (4, 7)} == {hashlib.sha256(b"1").hexdigest(), hashlib.sha256(b"2").hexdigest()}
    assert decontaminate.contamination(documents(spark, []), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(documents(spark, texts), items.limit(0)).collect())
    clean = decontaminate.keep_clean(documents(spark, texts), items)
    assert clean.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 6, 8, 9]


def test_one_contaminated_row_takes_no_others_along(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    texts = [(None, ITEM), (None, "clean without id"), (None, None), (5, ITEM), (5, "clean with the same id"), (6, "x " + ITEM), (7, "clean")]
    kept = decontaminate.keep_clean(documents(spark, texts), items).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, "clean without id"), (None, None), (5, "clean with the same id"), (7, "clean")])


# Chat


def test_formatted_examples(spark):
    said = [(1, 0, "system", "S"), (1, 1, "user", "a<|im_end|>\\b"), (1, 2, "assistant", "A\\<|"), (1, 3, "user", None), (1, 4, "assistant", "B"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (None, None, None, None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, 0, "user", "é" * 100_000), (4, 1, "assistant", "\\" * 1000)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in said], "conv_id long, turn long, role string, text string, example int, formatted int, conv int")
    examples = chat.format_turns(df)
    rows = sorted(examples.where("conv_id = 1").collect(), key=lambda r: r.example)
    assert [r.is_tail for r in rows] == [False, False, True]
    for r, reply in zip(rows, ["A\\\\<\\|", "B", ""], strict=True):
        assert r.formatted[r.loss_start : r.loss_start + r.loss_length] == reply
    assert rows[0].formatted == "<|im_start|>system<|im_sep|>S<|im_end|>\n<|im_start|>user<|im_sep|>a<\\|im_end|>\\\\b<|im_end|>\n<|im_start|>assistant<|im_sep|>A\\\\<\\|<|im_end|>\n"
    assert rows[1].formatted.startswith(rows[0].formatted)
    found = {r.conv_id: r for r in chat.digest(examples).collect()}
    by = defaultdict(list)
    for c, t, role, text in said:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert found[c].n_turns == len(ts)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


# Language model


def test_language_model_edges(spark):
    rows = language_model.score_documents(documents(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    train = [language_model.tokens((t or "").encode()) for i, t in EDGES if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for x in train for w in x)
    n, v = sum(counts.values()), len(counts)
    of = defaultdict(list)
    for i, t in EDGES:
        of[i].append(language_model.tokens((t or "").encode()))
    for r in rows:
        x = of[r.doc_id][0]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(counts[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert language_model.score_documents(documents(spark, [])).count() == 0


def test_lm_later_round_is_run_and_raises_the_held_out_score(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def held_out(**training):
        own = language_model.score_documents(docs, **training).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
        return own[0] / own[1]

    assert held_out() > held_out(rounds=1) + 0.001


def test_lm_takes_no_python_step_for_each_word(spark, monkeypatch):
    runs = []
    own = language_model.on_texts
    monkeypatch.setattr(language_model, "on_texts", lambda df, run, *more: runs.append(run) or own(df, run, *more))
    language_model.score_documents(documents(spark, [(k, f"aa bb {k}") for k in range(50)]), sizes=language_model.Sizes(16, 16, 1024)).count()
    assert len(runs) == 4  # counts, the tallies of two rounds, scores

    def calls(run, words):
        row = {"doc_id": pa.array([1])} if run is runs[-1] else {}
        batch = pa.RecordBatch.from_pydict(row | {"text": pa.array([" ".join(str(100000 + k) for k in range(words))])})
        events = []
        sys.setprofile(lambda frame, event, arg: events.append(event))
        try:
            for _ in run([batch]):
                pass
        finally:
            sys.setprofile(None)
        return len(events)

    for run in runs:
        calls(run, 10)
        assert calls(run, 4000) < calls(run, 1000) + 1000


def test_lm_words_by_bytes_are_those_of_plain_python():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"aZ \t\n\x0b\x0c\r\x1c\xc3\xa9\x00bq") for _ in range(rng.randrange(120))) for _ in range(300)]
    texts += [None, b"", b" ", b"\n", *(b"Q" * k for k in range(70)), bytes(range(256)) * 2, b""]
    plain = [language_model.tokens(x or b"") for x in texts]
    column = pa.array([b"before", *texts], pa.binary())[1:]  # a slice, as batches have
    words = language_model.split(column)
    assert words.array().to_pylist() == [w for x in plain for w in x] and words.sizes.tolist() == list(map(len, plain))
    model, _ = fitted(["q zz aa"] * 3 + ["bq"], language_model.Sizes(4, 16, 1024))
    known = pa.array(model.words, pa.binary())
    for a, b in zip(language_model.laid_out(plain, model.ids()), language_model.placed(words.ids(known), words.sizes), strict=True):
        assert np.array_equal(a, b)
    n = len(model.words)
    which = np.flatnonzero(words.ids(known) >= n)
    found = [{x["word"]: x["times"] for x in own} for own in language_model.times_in_texts(words, which).to_pylist()]
    assert found == [Counter(w for w in x if w not in model.words) for x in plain]
    assert len(language_model.split(pa.array([], pa.string())).sizes) == 0


def test_lm_expected_tokens_of_rows_seen_very_often_are_exact():
    model, _ = fitted(["aa bb aa"] * 20 + ["cc dd"], rounds=1)
    texts = [[b"aa"] * (3 * language_model.OFTEN), [b"cc", b"dd"]]
    places, real = language_model.laid_out(texts, model.ids())
    tally = language_model.Tally(model)
    tally.add(places, real)
    _, node, _, rows = language_model.decisions(model, places, real)
    p = language_model.shares(model, node, rows)
    p *= language_model.STEP / p.sum(axis=1, keepdims=True)
    for found, r in zip(tally.expected, rows, strict=True):
        assert np.bincount(r).max() > language_model.OFTEN
        for own, column in zip(found, np.rint(p).T, strict=True):
            assert np.array_equal(own, np.bincount(r, column, model.rows))


def fitted(texts, sizes=language_model.Sizes(64, 16, 1024), rounds=2):
    """The model of a list of texts, without Spark."""
    texts = [language_model.tokens(x.encode()) for x in texts]
    counts = Counter(w for x in texts for w in x)
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: sizes.vocabulary]
    rest = [[0, 0] for _ in range(sizes.buckets)]
    for w, c in counts.items():
        if w not in dict(head):
            rest[language_model.word_hash(w) % sizes.buckets][0] += c
            rest[language_model.word_hash(w) % sizes.buckets][1] += 1
    model = language_model.start_model(head, rest, sum(counts.values()), len(counts), sizes.rows)
    seen = None
    for _ in range(rounds):
        tally = language_model.Tally(model)
        tally.add(*language_model.laid_out(texts, model.ids()))
        if seen is None:
            seen = [x.reshape(-1, language_model.WIDE).astype(float) for x in tally.seen]
            language_model.updated(model, seen, None)
        else:
            language_model.updated(model, seen, [x.T / language_model.STEP for x in tally.expected])
    return model, counts


def walked(model, counts, text):
    """The score of a text, step by step down the tree, from the model's weights."""
    of, leaves = {}, {}
    for k, w in enumerate(model.words):
        of[w] = leaves[w] = k
    n = len(model.words)
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & mask
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & mask
        return (h ^ h >> 33) >> 32

    total, before = 0.0, [mask, mask]  # two starting marks
    for w in language_model.tokens(text.encode()):
        own = of.get(w, n + language_model.word_hash(w) % language_model.RARE_CONTEXTS)
        leaf = leaves.get(w, n + language_model.word_hash(w) % len(model.bucket_logs))
        one, two = before[-1], before[-2]
        hashes = [mix(one), mix((one * 0x9E3779B97F4A7C15 + two) & mask), mix((two + (1 << 40)) & mask)]
        for place in range(model.first[leaf], model.first[leaf] + model.steps[leaf]):
            node = model.node[place]
            logits = [float(model.base[node, j]) + sum(float(m[model.offset[node] + (h & int(model.mask[node])), j]) for m, h in zip(model.weights, hashes, strict=True)) for j in range(language_model.WIDE)]
            total += logits[model.child[place]] - math.log(sum(map(math.exp, logits)))
        if w not in of:
            total += math.log(counts[w] + 0.5) - float(model.bucket_logs[leaf - n])
        before.append(own)
    return total / math.log(10)


def test_every_class_is_a_distribution_and_the_word_itself_is_learnt():
    rng = random.Random(1)
    texts = [" ".join(rng.choice([["aa", "bb"], ["cc", "dd"]])[k % 2] for k in range(30)) + f" x{rng.randrange(500)}" for _ in range(300)]
    model, counts = fitted(texts)
    places, real = language_model.laid_out([language_model.tokens(x.encode()) for x in texts[:3]], model.ids())
    logs = language_model.log_probabilities(model, places, real)
    assert len(logs) == len(real) and (logs < 0).all()
    # all leaves after one history add up to 1, and the two words that follow half the time each take most of it
    every = len(model.words) + len(model.bucket_logs)
    history = [model.ids()[b"bb"], model.ids()[b"aa"]]
    after = np.array([[-1, *history, leaf] for leaf in range(every)], np.int64)
    p = np.exp(language_model.log_probabilities(model, after.ravel(), np.arange(every) * 4 + 3))
    assert np.isclose(p.sum(), 1, atol=1e-4)
    assert p[model.ids()[b"bb"]] > 0.4 and p[model.ids()[b"dd"]] > 0.4 and p[model.ids()[b"aa"]] < 0.05


def test_scores_are_those_of_a_plain_walk(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, 4000, 40)]
    rows = list(enumerate(texts))
    training = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    model, counts = fitted(training, language_model.Sizes(1 << 20, 16, 1024))
    docs = documents(spark, rows)
    found = {r.doc_id: r.score for r in language_model.score_documents(docs.repartition(3), rounds=2, sizes=language_model.Sizes(1 << 20, 16, 1024)).collect()}
    for i, t in rows:
        assert math.isclose(found[i], walked(model, counts, t), rel_tol=1e-4)
    # with buckets; the fit doesn't depend on how rows fall into tasks
    sizes = language_model.Sizes(64, 16, 1024)
    few = [{r.doc_id: r.score for r in language_model.score_documents(docs.repartition(n), rounds=2, sizes=sizes).collect()} for n in (1, 7)]
    assert few[0] == pytest.approx(few[1], rel=1e-6)
    assert sum(found.values()) > sum(few[0].values())


def test_head_words_are_the_most_frequent_and_ties_are_cut(spark):
    counts = spark.createDataFrame([(f"a{k}".encode(), 1000 + k) for k in range(50)] + [(f"b{k}".encode(), 1) for k in range(3000)], "word binary, c long")
    head = language_model.head_words(counts, 1050).collect()
    assert {bytes(r.word) for r in head if r.c > 1} == {f"a{k}".encode() for k in range(50)}
    assert 900 < sum(r.c == 1 for r in head) < 1100


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_model.score_documents(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# Sharding


def check_law(rows, n, shards):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards_keep_groups_together(spark):
    texts = [(k, f"text {k % 97}") for k in range(970)] + [(k, f"alone {k}") for k in range(970, 1500)]
    rows = sharding.shard_documents(documents(spark, texts), shards=20).collect()
    check_law(rows, 1500, 20)
    of = defaultdict(set)
    said = dict(texts)
    for r in rows:
        of[said[r.doc_id]].add(r.shard)
        assert r.size == len(said[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(said[r.doc_id].encode())
    assert sum(len(x) > 1 for x in of.values()) <= 25


def test_a_group_larger_than_a_shard(spark):
    rows = sharding.shard_documents(documents(spark, [(k, "same") for k in range(500)] + [(k, f"t{k}") for k in range(500, 1000)]), shards=40).collect()
    check_law(rows, 1000, 40)


@pytest.mark.parametrize("sizes", [[60, 40, 100, 25, 2, 3, 2], [100] * 6 + [51] * 6 + [7] * 9, [3, 5, 2, 2]])
def test_groups_that_fit_a_shard_stay_whole(spark, sizes):
    texts = [f"group {k}" for k, n in enumerate(sizes) for _ in range(n)]
    quota = 100 if max(sizes) > 5 else 5
    texts = list(enumerate(texts + [f"alone {k}" for k in range(20 * quota - len(texts))]))
    random.Random(2).shuffle(texts)
    rows = sharding.shard_documents(documents(spark, texts), shards=20).collect()
    check_law(rows, len(texts), 20)
    of = defaultdict(set)
    for r in rows:
        of[dict(texts)[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in of.values())


def test_a_group_beyond_a_shard_takes_no_more_than_it_needs(spark):
    texts = [(k, "same") for k in range(250)] + [(k, f"t{k}") for k in range(250, 2000)]
    rows = sharding.shard_documents(documents(spark, texts), shards=20).collect()
    check_law(rows, 2000, 20)
    assert len({r.shard for r in rows if r.doc_id < 250}) == 3


def test_sharding_edges(spark):
    rows = sharding.shard_documents(documents(spark, EDGES)).collect()
    check_law(rows, len(EDGES), 40)
    assert {r.doc_id: (r.size, r.law, r.grown_shard) for r in rows}[1] == (16, "rows", None)
    assert sharding.shard_documents(documents(spark, [])).count() == 0


# Licences


def test_licences_are_found_and_inherited(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("LICENSE", mit), ("src/a.py", "code"), ("src/b.py", f"# {apache}\ncode"), ("src/deep/er/c.py", None), ("lib/COPYING.txt", apache), ("lib/x/d.py", ""),
        ("lib/x/d.py", ""), ("e.py", "this license plate is red"), (None, apache), ("libx/f.py", "f" * 100_000), ("two.py", f"{apache}\n{mit}"),
    ]
    df = spark.createDataFrame([(p, t, 1, 2, 3) for p, t in files], "path string, text string, row int, dir int, segment int")
    rows = licenses.scan_licenses(df).collect()
    assert Counter((r.path, r.own_license, r.license, r.inherited_from) for r in rows) == Counter([
        ("LICENSE", "MIT", "MIT", None), ("src/a.py", None, "MIT", ""), ("src/b.py", "Apache-2.0", "Apache-2.0", None), ("src/deep/er/c.py", None, "MIT", ""),
        ("lib/COPYING.txt", "Apache-2.0", "Apache-2.0", None), ("lib/x/d.py", None, "Apache-2.0", "lib"), ("lib/x/d.py", None, "Apache-2.0", "lib"), ("e.py", None, "MIT", ""),
        (None, "Apache-2.0", "Apache-2.0", None), ("libx/f.py", None, "MIT", ""), ("two.py", "Apache-2.0", "Apache-2.0", None),
    ])
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_wrapped_headers_and_whole_licence_files(spark):
    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main() { return 0; }"
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at http://mozilla.org/MPL/2.0/.\nimport os"
    bsd = "Copyright (c) 2020, Some Body\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    files = [("a.c", gpl), ("b.py", mpl), ("lib/LICENSE", bsd), ("lib/x.py", "code"), ("c.py", "the licence of this poem\nis not one of those"), ("d.py", gpl.replace("version 3", "version 2"))]
    lesser = gpl.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
    eclipse = "// This program and the accompanying materials are made\n// available under the terms of the Eclipse Public License 2.0\n// which is available at https://www.eclipse.org/legal/epl-2.0/\ncode"
    files += [("e.c", lesser), ("f.c", eclipse), ("g.py", "# Not licensed under the MIT License."), ("h.txt", "Licensed under the GNU Lesser General Public License, version 2.1")]
    rows = licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()
    found = {r.path: r.license for r in rows}
    assert [found.pop(k) for k in ("e.c", "f.c", "g.py", "h.txt")] == ["LGPL-2.1", "EPL-2.0", None, "LGPL-2.1"]
    assert found == {"a.c": "GPL-3.0", "b.py": "MPL-2.0", "lib/LICENSE": "BSD-2-Clause", "lib/x.py": "BSD-2-Clause", "c.py": None, "d.py": "GPL-2.0"}


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain & simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a</div><div>b</div>", "a\nb"), ("<b>a</b> <i>b</i>c", "a bc"),
        ("<ul><li>a<li>b</ul>", "* a\n* b"), ("<ol start=9><li>a<li>b<ul><li>c</ul></ol>d", "9. a\n10. b\n    * c\n\nd"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<table><tr><td colspan=2>a<td>b<tr><td>cc<td>dd<td>e</table>", "a       b\ncc  dd  e"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"), ("<table><tr><td><table><tr><td>x<td>y</table><td>z</table>", "x  y  z"), ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style>", "x"), ("<p hidden>no</p>yes<span style='DISPLAY : none'>no</span>", "yes"), ("<!-- a > b -->x<!doctype html>y<?php z ?>w", "xyw"),
        ("1 < 2 &lt; 3 &amp;amp;", "1 < 2 < 3 &amp;"), ("<title>no</title><textarea> a </textarea>", " a"), ("<blockquote>a<p>b</blockquote>", "> a\n\n> b"), ("a<p", "a"), ("</p>a</div>", "a"),
        ("<a title='x>y'>b</a>", "b"), ("<td>x", "x"), ("<h1>T</h1>x", "T\n\nx"), ("<noscript>no</noscript><select><option>o</select>y", "y"), ("\0a", "a"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<table><tr><td>x<td rowspan=0>y<td>z<tr><td>1<td>2</table>", "x  y  z\n1     2"),
        ("<table><tr><td colspan=900>a<tr><td>b<td>c</table>", "a\nb  c"), ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<div style='display:none'>no<b style='visibility:visible;display:block'>no</b></div>x", "x"), ("<style>.gone, p.b {color:red; display : none}</style><i class='x gone'>no</i><p class=b>no<p>yes", "yes"),
        ("<style>#a{display:none}#a{display:block}.c{visibility:hidden}</style><p id=a>yes<p class=c>no<b style='visibility:visible'>seen</b>", "yes\n\nseen"),
        ("<style>@media print{.p{display:none}} @media screen { .s { display:none } } /* .q{display:none} */ div .d{display:none}</style><p class=p>a<p class=s>no<p class=q>b<div><p class=d>c</div>", "a\n\nb\n\nc"),
        ("<style media=print>p{display:none}</style><p>a", "a"), ("<p class=late>no<style>.late{display:none}</style>x", ""),
    ],
)
def test_render(page, text):
    assert html_text.render(page) == text


def test_deep_lists_stay_in_proportion():
    page = "<ul><li>x" * 4000
    text = html_text.render(page)
    assert text.split("\n")[0] == "* x" and text.split("\n")[16] == 32 * " " + "* x" and text.split("\n")[17] == 32 * " " + "[17] * x"
    assert text.count("x") == 4000 and len(text) < 20 * len(page)


def test_rendering_deep_and_long_pages():
    assert html_text.render("<div>" * 50_000 + "x") == "x"
    assert len(html_text.render("<p>word " * 50_000).split()) == 50_000


def test_all_visible_words_of_pages_are_kept(spark, sf_dir):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("head", "script", "style", "noscript", "template")

        def handle_endtag(self, tag):
            self.off -= tag in ("head", "script", "style", "noscript", "template")

        def handle_data(self, data):
            if not self.off:
                self.out += data.split()

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        if "hidden" in r.html or "display" in r.html or "noscript" in r.html:
            continue
        plain = Words()
        plain.feed(r.html)
        plain.close()
        ours = [w for w in texts[r.page_id].split() if w not in ("*", ">")]
        assert "".join(ours).replace("*", "").replace(">", "") == "".join(plain.out).replace("*", "").replace(">", ""), r.page_id


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p>a", "t"), (3, "<p>a", "t"), (None, "b", "t")], "page_id long, html string, text string")
    assert [r.text for r in html_text.extract_text(df).collect()] == ["", "", "a", "a", "b"]
    assert html_text.extract_text(df.limit(0)).count() == 0

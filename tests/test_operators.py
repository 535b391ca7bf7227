"""Hand-derived rows for operators, and properties."""

from __future__ import annotations

import json
import random
import struct
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.functions import hashing as H
from dialoom.functions import text as T
from dialoom.functions.turns import TURNS
from dialoom.operators import dedup, filters, formats, ngrams, plugins, recency, repair, reshape, stats
from dialoom.sources import scan, sinks
from dialoom.streaming import dedup as stream


def turns(spark, *said):
    return spark.createDataFrame([([(a, b) for a, b in x],) for x in said], f"turns {TURNS}")


def one(df):
    return df.first()[0]


H_, G_, S_ = "human", "gpt", "system"


@pytest.mark.parametrize(
    ("said", "toggles", "verdict", "left"),
    [
        ([(H_, "Hi."), (G_, "   ")], {}, "blank_turn", None),
        ([(S_, ""), (H_, "Hi."), (G_, "Yo.")], {}, "kept", [S_, H_, G_]),
        ([(S_, ""), (H_, "Hi."), (G_, "Yo.")], {"allow_empty_system": False}, "empty_system", None),
        ([(H_, "Hi."), (G_, "and then")], {}, "invalid_ending", None),
        ([(H_, "ok"), (G_, "Fine.")], {}, "invalid_ending", None),
        ([(H_, "Hi!"), (G_, "Fin é")], {}, "kept", [H_, G_]),
        ([(H_, "Hi."), (G_, None)], {"blank": False}, "null_gpt", None),
        ([(S_, " ABC. "), (H_, "abc."), (G_, "Z.")], {}, "kept", [H_, G_]),
        ([(H_, "Say  Hi."), (G_, "say hi.")], {}, "echo", None),
        ([(H_, "Hi."), (H_, "Yo.")], {}, "missing_role", None),
        ([(H_, "A."), (G_, "B."), (H_, "C."), (H_, "D.")], {}, "kept", [H_, G_, H_]),
        ([], {}, "missing_role", None),
    ],
)
def test_judge(spark, said, toggles, verdict, left):
    row = filters.judge(turns(spark, said), **toggles).first()
    assert row.verdict == verdict
    if left is not None:
        assert [t["from"] for t in row.turns] == left


def test_judging_twice_changes_nothing_that_is_kept_without_a_trailing_turn(spark):
    df = turns(spark, [(H_, "A."), (G_, "B."), (H_, "C.")], [(H_, "A."), (G_, "B.")])
    once = filters.keep_valid(df)
    assert sorted(filters.keep_valid(once).collect()) == sorted(once.collect())


def test_phrase_filter(spark):
    df = turns(spark, [(G_, "x")], [(G_, "aa")], [(G_, "aa bb cc")])
    rows = filters.drop_phrase_heavy(df, ["aa", "bb", "cc"]).collect()
    assert sorted((r.matches, r.kept) for r in rows) == [(0, True), (1, False), (3, False)]
    assert all(r.kept for r in filters.drop_phrase_heavy(df, ["none"]).collect())
    assert all(r.kept for r in filters.drop_phrase_heavy(df, ["aa"], None).collect())


def test_terms(spark):
    row = spark.createDataFrame([("<p>Tall <b>Slime</b>girl</p>",)], "t string")
    assert row.select(filters.passes_terms("t", ["slimegirl"]), filters.passes_terms("t", ["slime"]), filters.passes_terms("t", [], ["tall"])).first() == (False, True, False)


def test_scalars(spark):
    row = spark.createDataFrame([("naïve\nx", "café", "cafe", "  a b\t\n")], "a string, b string, c string, d string")
    assert row.select(T.ascii_scrub("a"), T.has_unwanted_unicode("b"), T.has_unwanted_unicode("c"), T.strip("d")).first() == ("navex", True, False, "a b")


def doc(spark, x):
    return spark.createDataFrame([(json.dumps(x) if not isinstance(x, str) else x,)], "raw string").select(F.try_parse_json("raw").alias("_doc"))


@pytest.mark.parametrize(
    ("given", "fmt", "expected"),
    [
        ({"messages": [{"role": "user", "content": " a "}, {"role": "tool", "content": "t"}, {"role": "assistant", "content": ""}]}, "huggingface", [(H_, "a")]),
        ({"conversations": [{"from": "ChatBot", "value": "x"}]}, "vicuna", [(G_, "x")]),
        ({"instruction": "I", "input": "", "output": "O"}, "alpaca", [(H_, "I"), (G_, "O")]),
        ({"instruction": "I", "input": "J", "output": ""}, "alpaca", [(H_, "I\nJ")]),
        ({"text": "<|im_start|>user\nhi<|im_end|>\n<|im_start|>tool\nx<|im_end|>"}, "chatml", [(H_, "hi")]),
        ({"conversations": [{"from": "Tool", "value": ""}]}, "sharegpt", [("tool", "")]),
        ({}, "unknown", [(S_, formats.SENTINEL)]),
        ({"system": "s", "completion": '[{"role":"user","content":"q"}]'}, "unknown", [(S_, "s"), (H_, "q")]),
        ({"instruction": None}, "alpaca", [(S_, formats.SENTINEL)]),
    ],
)
def test_convert(spark, given, fmt, expected):
    found = doc(spark, given).select(formats.extract("_doc", F.lit(fmt))).first()[0]
    assert [(t["from"], t["value"]) for t in found] == expected


def test_first_row_that_shows_a_format_decides(spark):
    rows = [("f", 0, "{}"), ("f", 1, '{"instruction":"i"}'), ("f", 2, '{"conversations":[{"from":"human","value":"x"}]}')]
    df = spark.createDataFrame(rows, "_file string, _pos int, _raw string").withColumn("_doc", F.try_parse_json("_raw"))
    assert formats.detect_format(df, "_file", "_pos").first().format == "alpaca"
    assert {r.format for r in formats.convert(df).collect()} == {"alpaca"}


def test_salvage(spark):
    df = spark.createDataFrame([("system: a user: b",), ("free",)], "x string")
    assert [[(t["from"], t["value"]) for t in r[0]] for r in df.select(formats.salvage(F.col("x"))).collect()] == [[(S_, "a user: b"), ("user", "b")], [("unknown", "free")]]


def messages(spark, said):
    return spark.createDataFrame([(said,)], f"m {repair.MESSAGES}")


@pytest.mark.parametrize(
    ("said", "reason"),
    [([], "Empty messages list"), ([(S_, "x")], "Only system message present"), ([("user", "a")], "Conversation ends on user"), ([("user", "a"), ("assistant", "b")], None), ([("user", "a"), ("user", "b")], "Message 1 breaks alternation"), ([("assistant", "a")], "First non-system message is not from the user"), ([("bot", "a")], "Message 0 has an invalid role")],
)
def test_validate(spark, said, reason):
    assert one(messages(spark, said).select(repair.why_invalid("m"))) == reason


@pytest.mark.parametrize(
    ("said", "expected"),
    [
        ([("user", "a")], None),
        ([("assistant", "a"), ("user", "b")], [("user", "a"), ("assistant", "b")]),
        ([("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "I understand.")]),
        ([("user", "a"), (S_, "S"), ("assistant", "")], [(S_, "S"), ("user", "a"), ("assistant", " ")]),
    ],
)
def test_fix(spark, said, expected):
    found = one(messages(spark, said).select(repair.fix("m")))
    assert (found and [tuple(m) for m in found]) == expected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "human", "bot", "system", "x", None]), st.one_of(st.none(), st.text(max_size=5))), max_size=6))
def test_fixed_messages_are_valid(spark, said):
    row = messages(spark, said).select(repair.fix("m").alias("f")).select("f", repair.why_invalid("f").alias("why")).first()
    assert row.f is None or row.why is None


def test_fingerprints(spark):
    df = spark.createDataFrame([("",), ("hello",), ("hello world",), ("Hello  WORLD hello",)], "t string")
    rows = df.select((H.simhash64("t")).alias("s"), H.prefix(H.simhash64("t")).alias("p")).collect()
    assert [r.s % (1 << 64) for r in rows] == [0, 13362634815750784402, 1243275522156529026, 13362634815750784402]
    assert [r.p for r in rows] == [0, 47473, 4417, 47473]
    sets = spark.createDataFrame([("abcd",), ("ab",), ("",)], "t string").select(H.char_shingles("t", 3).alias("s")).collect()
    assert [r.s for r in sets] == [["abc", "bcd"], ["ab"], []]
    assert one(spark.range(1).select(H.hamming(F.lit(0b1011), F.lit(0b0010)))) == 2


def test_shingles_of_a_long_text_take_time_in_proportion(spark):
    said = "".join(chr(97 + k * k % 23) + "é\n😀"[k % 3] for k in range(300_000))
    rows = spark.createDataFrame([(said,), ("é😀\nb",), ("abcdefghij",), (None,)], "t string").coalesce(1)
    began = time.perf_counter()
    found = [r.n for r in rows.select(F.size(H.char_shingles("t")).alias("n")).collect()]
    assert time.perf_counter() - began < 30
    assert found == [len({said[k : k + 10] for k in range(len(said) - 9)}), 1, 1, 0]
    assert set(one(rows.limit(1).select(H.char_shingles(F.substring("t", 1, 500))))) == {said[k : k + 10] for k in range(491)}


def test_leaders_are_not_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 12), (11, 12)], "a long, b long")
    assert sorted(map(tuple, dedup.resolve_leaders(pairs).collect())) == [(1, 2), (3, 4), (10, 12)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=14))
def test_leaders_follow_the_ordered_walk(spark, drawn):
    pairs = sorted({(min(p), max(p)) for p in drawn if p[0] != p[1]})
    if not pairs:
        return
    taken: dict[int, int] = {}
    for a, b in pairs:
        if a not in taken and b not in taken:
            taken[b] = a
    assert dict((m, x) for x, m in map(tuple, dedup.resolve_leaders(spark.createDataFrame(pairs, "a long, b long")).collect())) == taken


def test_near_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(300))
    df = spark.createDataFrame([(0, base), (1, base), (2, "other words " * 40), (3, None)], "i long, t string")
    assert [tuple(r) for r in dedup.near_duplicates(df, "i", "t").collect()] == [(0, 1)]


def test_choose_keep(spark):
    df = spark.createDataFrame([("g", "a", 100, 5, 0), ("g", "b", 100, 9, 1), ("g", "c", 100, 9, 2)], "g string, path string, px int, size int, pos int")
    assert dedup.choose_keep(df, "g", "path", F.col("px"), "size", "pos").first().keep == "b"


def test_ngrams(spark):
    texts = spark.createDataFrame([(0, "red fox runs fast"), (1, "red fox runs home"), (2, "runs fox red")], "o int, t string")
    grams = ngrams.ngrams(texts, "o", "t", 3, 3)
    assert {(r.ngram, r.cnt) for r in ngrams.top_ngrams(grams).collect()} == {("red fox runs", 2), ("fox runs fast", 1), ("fox runs home", 1), ("runs fox red", 1)}
    assert {(r.ngram, r.cnt) for r in ngrams.top_ngrams(ngrams.with_recency(grams)).collect()} == {("red fox runs", 1), ("fox runs fast", 1), ("fox runs home", 1)}
    row = spark.createDataFrame([("I'll go;\nit’s OK",)], "t string").select(ngrams.tokens(F.col("t")).alias("a"), ngrams.tokens(F.col("t"), False).alias("b")).first()
    assert row.a == ["i", '"', "ll", "go", ";", "it", '"', "s", "ok"]


@pytest.mark.parametrize(("window", "threshold", "chunk_bytes", "tried"), [(50, 0.85, 1 << 22, 64), (50, 0.85, 60, 1), (4, 0.85, 200, 2), (50, 0.7, 60, 1), (3, 0.4, 100, 64), (0, 0.85, 60, 64)])
def test_recent_ngrams_are_those_of_one_walk(spark, window, threshold, chunk_bytes, tried):
    """Wherever the walk is cut: also where chunks keep nothing, so that their state is that of chunks long before."""
    draw = random.Random(3)
    said = [" ".join(draw.choice("abcdefgh") + draw.choice("xyz,") for _ in range(draw.randrange(60))) for _ in range(60)] + ["one two three four five six"] * 30 + ["r s r s r s r s t u v w"] * 9 + ["", None, "one two", "é ß ñ ô one two three"]
    for rows in (said, said[::-1]) if chunk_bytes > 60 else (said, ["one two three"], [""]):
        texts = spark.createDataFrame(list(enumerate(rows)), "o int, t string").repartition(3)
        expected = sorted(map(tuple, ngrams.top_ngrams(ngrams.with_recency(ngrams.ngrams(texts, "o", "t"), window, threshold), 5).collect()))
        found = recency.recent_ngrams(texts, "o", "t", 5, window=window, threshold=threshold, buckets=1024, tried=tried, chunk_bytes=chunk_bytes)
        assert sorted(map(tuple, found.collect())) == expected


def test_walks_by_hashes_and_by_sets_keep_the_same():
    draw = np.random.default_rng(5)
    for kinds, window in ((3, 2), (40, 50), (60, 50), (400, 50), (1, 1), (7, 0)):
        codes = draw.integers(0, kinds, 3000)
        for before in ([], list(range(kinds))[:window]):
            every = np.concatenate([before, codes]).astype(np.int64)
            kept, dropped, by = recency.equal_walk(draw.permutation(1 << 12).astype(np.uint64)[every] << np.uint64(40), len(before), window)
            sets = [frozenset([x]) for x in every.tolist()]
            assert kept[len(before) :].tolist() == recency.plain_walk(sets[len(before) :], sets[: len(before)], window, 0.85, True).tolist()
            assert sorted(dropped.tolist()) == np.flatnonzero(~kept).tolist() and (every[dropped] == every[by]).all() and kept[by].all()


def test_recency_moves_no_ngrams(spark):
    """Texts move once, for their order; n-grams would be ten times as much."""
    draw, context = random.Random(7), spark.sparkContext
    word = lambda: "".join(draw.choices("bcdfgklmnprtvz", k=6))
    said = [" ".join(word() for _ in range(6)) for _ in range(10)]
    rows = [(k, " ".join([word() for _ in range(150)] + said)) for k in range(400)]

    def moved():
        every = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(every.apply(k).shuffleWriteBytes() for k in range(every.size()))

    before = moved()
    found = recency.recent_ngrams(spark.createDataFrame(rows, "o int, t string"), "o", "t", buckets=1024).collect()
    assert len(found) == 30 and {r.cnt for r in found} == {400} and moved() - before < 2 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize(("buckets", "tried"), [(1, 1), (4, 1), (16, 2), (1 << 18, 64)])
def test_frequent_ngrams_are_those_of_all_counts(spark, buckets, tried):
    """Full buckets may hold rare n-grams only, ties go to the first to appear, and texts may hold few n-grams or none."""
    said = ["a1 b1 c1 d1"] * 3 + ["x y z , w"] * 3 + [" ".join(f"w{k * k % 31}" for k in range(j, j + 40)) for j in range(4)] + ["", None, "one two"]
    for rows in (said, ["one two three"], [""]):
        texts = spark.createDataFrame(list(enumerate(rows)), "o int, t string")
        expected = sorted(map(tuple, ngrams.top_ngrams(ngrams.ngrams(texts, "o", "t"), 5).collect()))
        assert sorted(map(tuple, ngrams.frequent_ngrams(texts, "o", "t", 5, buckets=buckets, tried=tried).collect())) == expected


def test_percentiles(spark):
    row = stats.percentiles(spark.createDataFrame([(5,), (10,), (10,), (40,)], "n int"), "n").first()
    assert [row[f"p{k}"] for k in (10, 25, 50, 75, 90, 95, 99, 100)] == [6.5, 8.75, 10, 17.5, 31, 35.5, 39.1, 40]


def test_reshaping(spark):
    df = spark.range(23).withColumn("k", F.col("id") * 7 % 23)
    assert [r._pos for r in reshape.numbered(df, "k").orderBy("k").collect()] == list(range(23))
    files = spark.createDataFrame([("x_10.jsonl", 1), ("x_2.jsonl", 2), ("y.jsonl", 3)], "p string, n int")
    assert [r.p for r in reshape.merge_order(files, "p", "n", "p").orderBy("_pos").collect()] == ["y.jsonl", "x_2.jsonl", "x_10.jsonl"]
    rows = spark.range(5).withColumnRenamed("id", "_pos")
    assert [(r._pos, r.file) for r in reshape.shards(rows, "_pos", 2).where("_pos <> 1").orderBy("_pos").collect()][:2] == [(0, "train-00000-of-00003.parquet"), (2, "train-00001-of-00003.parquet")]
    assert sorted(map(tuple, reshape.shuffled(df, 3, "id").collect())) == sorted(map(tuple, df.collect()))


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"conversations":[{"from":"human","value":"é"}]}\n\n{bad\n{"a":1} junk\n{"a":NaN}\n')
    rows = scan.jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("_pos").collect()
    assert [r._doc is not None for r in rows] == [True, False, False, True]
    assert sinks.require_valid(scan.jsonl(spark, str(tmp_path / "a.jsonl"))).first().first_bad == 2
    with pytest.raises(Exception, match="malformed"):
        scan.jsonl(spark, str(tmp_path / "a.jsonl"), fail_fast=True).select(F.to_json("_doc")).collect()
    (tmp_path / "b.json").write_text('[{"a":1},{"a":2}]')
    assert scan.load(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.json").write_text('{"a":1}\n5\n{"a":2}')
    assert scan.load(spark, str(tmp_path / "c.json")).count() == 2
    with pytest.raises(ValueError, match="neither"):
        scan.load(spark, "x.csv")
    (tmp_path / "t.txt").write_text("# no\n\n one \ntwo\none\n")
    assert [r.text for r in scan.samples(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two", "one"]
    assert {(r.phrase, r._pos) for r in scan.phrases(spark, str(tmp_path / "t.txt")).collect()} == {("# no", 0), ("one", 2), ("two", 3)}
    sinks.write_conversations(turns(spark, [(H_, "é"), (G_, None)]), str(tmp_path / "out"))
    assert one(spark.read.text(str(tmp_path / "out"))) == '{"conversations":[{"from":"human","value":"é"},{"from":"gpt","value":null}]}'
    assert sinks.jsonl_to_parquet(spark, str(tmp_path / "out"), str(tmp_path / "pq")).count() == 1
    assert sinks.parquet_to_jsonl(spark, str(tmp_path / "pq"), str(tmp_path / "back")).count() == 1


def test_images_and_model_files(spark, tmp_path):
    for name, data in (("a.PNG", b"x"), ("b.png", b"x"), ("c.txt", b"x"), ("d.jpg", b"y")):
        (tmp_path / name).write_bytes(data)
    files = scan.images(spark, str(tmp_path))
    assert files.count() == 3
    groups = dedup.duplicate_groups(files, F.sha2("content", 256), "path").collect()
    assert len(groups) == 1 and groups[0].keep.endswith("a.PNG")
    header = json.dumps({"__metadata__": {}, "w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + bytes(8))
    assert [tuple(r) for r in scan.tensor_catalog(spark, str(tmp_path / "m.safetensors")).collect()] == [("w", "m.safetensors", "F32", [2])]
    (tmp_path / "i.json").write_text('{"weight_map":{"w":"pytorch_model-1.bin"}}')
    assert scan.rewritten_index(scan.weight_map(spark, str(tmp_path / "i.json"))).first().file == "model-1.safetensors"


def test_stream_across_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = '{"conversations":[{"from":"human","value":"%s"}]}\n'
    (source / "1.jsonl").write_text(line % "a" + line % "b")
    (source / "2.jsonl").write_text(line % "a" + "bad\n")
    seen = stream.first_seen(stream.conversation_stream(spark, str(source), 1), "sha")
    stream.in_batches(seen, lambda b: b, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_plugins(spark):
    assert plugins.frequent_word_language(["the cat is in the house", "der Hund ist nicht im Haus"])[0][0] == "en"
    calls = []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert plugins.retried(fails, sleep=lambda s: None) == "ok"
    assert len(plugins.prompt_queue(["a", "b"], 5, 1)) == 5
    m = messages(spark, [("user", "a"), ("assistant", "b")]).withColumnRenamed("m", "messages")
    good = plugins.ScriptedClient(['```json\n[{"role":"user","content":"c"},{"role":"assistant","content":"d"}]\n```'])
    assert plugins.improved(m, good).first().improved[0].content == "c"
    assert len(plugins.extended(m, good, 1).first().extended) == 4
    assert plugins.extended(m, good, 2).first().extended is None
    assert repair.balanced('x {"a": "}"} y', "{", "}") == '{"a":"}"}'
    assert repair.balanced("none", "[", "]") is None
    v = spark.createDataFrame([("abc",)], "t string").select(plugins.embed(F.col("t"), plugins.hashed_embedder()).alias("v")).first().v
    assert abs(sum(x * x for x in v) - 1) < 1e-5


def png(pixels, kind=2, how=(0, 1, 2, 3, 4)):
    """A PNG of rows x columns x channels, its rows filtered in turn by each of the methods."""
    import zlib

    h, w, c = len(pixels), len(pixels[0]), len(pixels[0][0])
    flat, lines = [[v for p in row for v in p] for row in pixels], b""
    for y, row in enumerate(flat):
        f = how[y % len(how)]
        above = flat[y - 1] if y else [0] * (w * c)
        out = []
        for x, v in enumerate(row):
            a, b, d = row[x - c] if x >= c else 0, above[x], above[x - c] if x >= c else 0
            p = a + b - d
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            out.append((v - (0, a, b, (a + b) // 2, nearest)[f]) & 255)
        lines += bytes([f, *out])

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_and_difference_hash(spark):
    import random

    from dialoom.operators import images

    rng = random.Random(1)
    picture = [[[rng.randrange(256) for _ in range(3)] for _ in range(27)] for _ in range(16)]
    assert images.decode_png(png(picture)).tolist() == picture
    rising = [[[10 * x] * 3 for x in range(18)] for _ in range(16)]
    df = spark.createDataFrame([(1, png(rising)), (2, png([row[::-1] for row in rising])), (3, b"no"), (4, None), (5, png(rising, how=(0,)))], "i int, content binary")
    rows = {r.i: r.d for r in df.select("i", images.described("content").alias("d")).collect()}
    assert (rows[1].dhash, rows[1].width, rows[1].height) == (-1, 18, 16) and rows[2].dhash == 0
    assert rows[3].dhash is None and rows[4].dhash is None
    same = df.select(F.col("i").cast("long").alias("i"), images.described("content").dhash.alias("code")).where("code is not null")
    assert [tuple(r) for r in dedup.perceptual_duplicates(same, "i", "code").collect()] == [(1, 5)]


def test_processed_lines(spark):
    m = spark.createDataFrame([(k, [("user", "a"), ("assistant", "b")]) for k in range(4)], f"_pos int, messages {repair.MESSAGES}")
    good = plugins.ScriptedClient(['[{"role":"user","content":"c"},{"role":"assistant","content":"d"}]'])
    rows = plugins.processed(m, good, "_pos", 2, 3, "S").orderBy("_pos").collect()
    assert [[x.content for x in r.result] for r in rows] == [["a", "b"], ["S", "c", "d"], ["S", "c", "d"]]
    bad = plugins.ScriptedClient(["no"])
    assert [r.reason for r in plugins.processed(m, bad, "_pos", 2, 3).orderBy("_pos").collect()] == [None, "no answer", "no answer"]

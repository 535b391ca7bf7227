from __future__ import annotations

import pytest
from checks import DATA, same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from dialoom.llm import decontaminate, neardup, packing, quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    same_rows(spark, DATA, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_a_row_for_each_row(spark, name):
    found = queries.QUERIES[name](spark, DATA)
    of = "pages" if name.startswith("op10") else "documents"
    key = "page_id" if of == "pages" else "doc_id"
    assert found.select(key).distinct().count() == spark.read.parquet(f"{DATA}/{of}.parquet").count()


def test_pipeline_is_its_stages(spark):
    """Each stage keeps what its operator says of the rows that it is given."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    good = quality.quality_scores(docs, labels).where("predicted = 1").select("doc_id")
    left = docs.join(good, "doc_id", "left_semi").select(docs.columns)
    left = left.join(neardup.near_duplicates(left).where("kept").select("doc_id"), "doc_id", "left_semi")
    left = left.join(decontaminate.contamination(left, items).where("not contaminated").select("doc_id"), "doc_id", "left_semi")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    expected = sorted(map(tuple, packing.token_pieces(left).select(columns).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select(columns).collect())) == expected
    assert 0 < len({x[0] for x in expected}) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("id", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.schema == docs.schema
        assert kept.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    """All stages over rows with null and repeated ids, null texts, copies and contaminated texts, against brute force."""
    import re
    from collections import Counter

    words = [f"w{k}" for k in range(120)]
    item = " ".join(f"q{k}" for k in range(20))
    near = " ".join([*words[:-1], "other"])
    texts = [
        (1, " ".join(words)), (2, near), (3, " ".join(words)), (None, " ".join(words)), (4, "alone and clean " * 3), (4, "the same id but another text"), (4, "the same id but another text"),
        (5, f"x y {item} z"), (None, f"no id {item}"), (None, "clean without id"), (6, None), (7, None), (8, ""), (9, "a " * 400 + item), (10, "!!! $$$ " * 30), (11, "JUNK!! " * 40),
    ]
    labels = [(k, int(k % 2 == 0), 0) for k in range(100, 180)]
    texts += [(k, f"fine words number {k} stand here in a row and end well ." if good else f"!!! $$$ {k} " * 30) for k, good, _ in labels]
    for name, rows, schema in (
        ("documents", [(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item), (2, None)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # quality: a text's verdict is that of all rows with it
    folder = str(tmp_path)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    good = {r.text for r in kept.collect()}
    left = [(i, t) for i, t in texts if t in good]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(left) and 0 < len(left) < len(texts)

    # near-duplicates: rows linked by id and text, one of each group stays, rows without id stay
    sets = [frozenset(neardup.shingles((t or "").encode()).tolist()) if i is not None else frozenset() for i, t in left]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for k, (i, _) in enumerate(left):
        if sets[k] and (group[k] not in best or i < left[best[group[k]]][0]):
            best[group[k]] = k
    expected = Counter(x for k, x in enumerate(left) if not sets[k] or best[group[k]] == k)
    once = corpus_pipeline.STAGES[1][1](spark, kept, folder)
    found = Counter((r.doc_id, r.text) for r in once.collect())
    assert sum(found.values()) == sum(expected.values())
    assert {i for i, _ in found} == {i for i, _ in expected}

    # decontamination: thirteen words in a row
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {tuple(cut(item)[k : k + 13]) for k in range(8)}

    def dirty(t):
        w = cut(t)
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    clean = corpus_pipeline.STAGES[2][1](spark, once, folder)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter({x: n for x, n in found.items() if not dirty(x[1])})

    # packing: every document's ids once
    own = packing.encoder()
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in clean.collect())
    assert sum(r.length for r in packed) == sum(len(own.encode(r.text or "")) + 1 for r in clean.collect())

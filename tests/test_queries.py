from __future__ import annotations

import os
import shutil

import numpy as np
import pytest
from checks import same_rows

from dialoom.plans import chat_queries, io_queries, text_queries

PLANS = [chat_queries.REG, text_queries.REG, io_queries.REG]
ALL = {k: f for p in PLANS for k, f in p.queries.items()}
SQL = {k: q for p in PLANS for k, q in p.sql.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, ALL[name], SQL[name])


# Held against plain Python in test_bruteforce.py and below.
WITHOUT_SQL = {
    "captioned_images", "corrected_replies", "difference_hashes", "embedded_texts", "improved_messages", "json_fence_extract", "language_filter", "minhash_estimates", "neardup_dedup",
    "ngram_recency", "null_space_projector", "perceptual_groups", "processed_entries", "scored_sentences", "shuffle_seeded", "streamed_generations", "tokenize_rows",
}


def test_queries_without_sql_are_known():
    assert set(ALL) - set(SQL) == WITHOUT_SQL


def test_projector_is_that_of_all_vectors(spark, sf_dir):
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").collect()], float)
    values, spanned = np.linalg.eigh(x.T @ x)
    kept = spanned[:, np.sqrt(np.maximum(values, 0)) > 0.01 * np.sqrt(values.max())]
    rows = sorted(ALL["null_space_projector"](spark, sf_dir).collect(), key=lambda r: r.dim)
    assert np.allclose([r.row for r in rows], np.eye(x.shape[1]) - kept @ kept.T)


def test_formats_are_read_from_all_turns(spark, tmp_path):
    rows = [(0, 3, "user", "a"), (4, 0, "user", "b"), (4, 5, "user", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = ALL["detect_format"](spark, str(tmp_path)).collect()
    assert {r.conv_id: r.format for r in found} == {0: "sharegpt", 4: "chatml"}


@pytest.mark.parametrize("name", ["canonical_turns", "complete_turns", "duplicate_system", "exact_dedup_conversations", "filter_composite", "fix_messages", "message_roundtrip"])
def test_capitals_are_alike_on_both_engines(spark, tmp_path, name):
    rows = [(k, t, ("user", "assistant")[t % 2], f"Straße ŉ ǰ ΐ ᾳ ﬁ \u019b \U00010d70 é {t}.") for k in (2, 17, 32, 107) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/parts")
    os.rename(next(tmp_path.glob("parts/*.parquet")), tmp_path / "conversations.parquet")
    shutil.rmtree(tmp_path / "parts")
    same_rows(spark, str(tmp_path), ALL[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

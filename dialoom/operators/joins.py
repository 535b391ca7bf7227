"""Membership, lookup and containment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def existing(df: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return df.join(there.select(key), key, "left_semi")


def zip_by_position(left: DataFrame, right: DataFrame, pos: str) -> DataFrame:
    return left.join(right, pos)


def catalog_status(index: DataFrame, disk: DataFrame, key: str = "tensor", file: str = "file") -> DataFrame:
    """key, file and status of an index against what is on disk, from both sides."""
    a = index.select(key, F.col(file).alias("listed"))
    b = disk.select(key, F.col(file).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("found"), "moved").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, F.coalesce("found", "listed").alias(file), status.alias("status"))


def contains_join(df: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(row, phrase) where the text holds the phrase, for lists too long for literals: candidates share the phrase's first
    word, then containment is tested."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    keyed = phrases.select(phrase, F.get(words(F.col(phrase)), F.lit(0)).alias("_w")).where("_w is not null")
    rows = df.withColumn("_w", F.explode(F.array_distinct(words(F.col(text)))))
    return rows.join(keyed, "_w").where(F.contains(text, phrase)).drop("_w")

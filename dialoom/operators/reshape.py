"""Order, split, merge, shuffle, shards and numbered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.functions.storage import written


def numbered(df: DataFrame, *order: str, name: str = "_pos") -> DataFrame:
    """A gapless number from 0 along the order, from a range partitioning and a count for each partition, so that no task
    sorts the whole. The dealt rows are written once: both uses must see the same partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = written(dealt, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg((F.max("_in") + 1).alias("_n"))  # a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def split_parts(df: DataFrame, pos: str, size: int) -> DataFrame:
    """part, from 1: `size` rows each along pos (gapless from 0)."""
    return df.withColumn("part", (F.floor(F.col(pos) / size) + 1).cast("int"))


def file_index(path: Column | str) -> Column:
    """The number behind the last underscore of the file's stem; 0 without one."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    found = F.regexp_extract(stem, r"_(\d+)$", 1)
    return F.when(found == "", 0).otherwise(found.cast("int"))


def merge_order(df: DataFrame, path: str, given: str, line: str) -> DataFrame:
    """Number the lines of many files: by the files' trailing numbers, then as given."""
    return numbered(df.withColumn("_index", file_index(F.col(path))), "_index", given, line).drop("_index")


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """A seeded order that doesn't depend on the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def line_range(df: DataFrame, pos: str, first: int, last: int) -> DataFrame:
    """1-based: rows before `first` are copied, those up to `last` are to be processed, later ones go."""
    at = F.col(pos) + 1
    return df.where(at <= last).withColumn("processed", at >= first)


def shards(df: DataFrame, pos: str, rows: int, total: Column | None = None) -> DataFrame:
    """shard and its file name; numbers come from pos, so rows that are missing leave shards smaller."""
    n = df.agg((F.floor(F.max(pos) / rows) + 1).alias("_n"))
    out = df.withColumn("shard", F.floor(F.col(pos) / rows).cast("int")).join(F.broadcast(n))
    name = F.format_string("train-%05d-of-%05d.parquet", F.col("shard"), F.col("_n").cast("int"))
    return out.withColumn("file", name).drop("_n")


def subdirectory(path: Column | str, size: int) -> Column:
    """A five-digit folder by the numeric stem; others go to 0."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.lpad(F.floor(F.coalesce(F.when(stem.rlike("^[0-9]{1,18}$"), stem).cast("long"), F.lit(0)) / size).cast("string"), 5, "0")


def unique_names(df: DataFrame, path: str, order: str, between: str = "_") -> DataFrame:
    """Add `target`: the base name, with _1, _2, ... for later rows of the same name (between="__dup" for moved duplicates).

    The number is the distance from the name's first row in an order over all rows, so a frequent name takes no task for
    itself.
    """
    base = F.element_at(F.split(path, "/"), -1)
    ranked = written(numbered(df.withColumn("_base", base), "_base", order, name="_at"), "names")
    first = ranked.groupBy("_base").agg(F.min("_at").alias("_first"))
    k = F.col("_at") - F.col("_first")
    stem, ext = F.regexp_extract("_base", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("_base", r"^(.*?)(\.[^.]*)?$", 2)
    target = F.when(k == 0, F.col("_base")).otherwise(F.concat(stem, F.lit(between), k.cast("string"), ext))
    return ranked.join(first, "_base").withColumn("target", target).drop("_base", "_at", "_first")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows along the order: limits and previews."""
    return df.orderBy(*order).limit(n)


def last_per(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*(F.col(c) for c in df.columns)), F.col(order)).alias("r")).select("r.*")


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value with the first place it occurs at."""
    return df.groupBy(value).agg(F.min(order).alias(order))

"""Sinks: JSONL, Parquet, shards, rejects, named files and reports."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def json_line(*columns: str) -> Column:
    """A compact object with nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, *columns: str) -> None:
    df.select(json_line(*(columns or df.columns)).alias("value")).write.text(path)


def write_conversations(df: DataFrame, path: str, turns_col: str = "turns") -> None:
    df.select(F.col(turns_col).alias("conversations")).select(json_line("conversations").alias("value")).write.text(path)


def finite(column: Column, kind: DataType) -> Column:
    """NaN as null, at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(column), column)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: finite(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*(finite(column[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, MapType):
        return F.transform_values(column, lambda _, v: finite(v, kind.valueType))
    return column


def sanitised(df: DataFrame) -> DataFrame:
    return df.select(*(finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def jsonl_to_parquet(spark, source: str, target: str, compression: str = "snappy") -> DataFrame:
    """The whole input fixes the schema; five rows come back as a preview."""
    df = spark.read.json(source)
    df.write.option("compression", compression).parquet(target)
    return df.limit(5)


def parquet_to_jsonl(spark, source: str, target: str) -> DataFrame:
    df = sanitised(spark.read.parquet(source))
    write_jsonl(df, target)
    return df.limit(5)


def write_split(judged: DataFrame, path: str, verdict: str = "verdict") -> None:
    """Kept and rejected rows side by side, from one pass: a folder for each verdict."""
    judged.write.partitionBy(verdict).option("compression", "zstd").parquet(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard", compression: str = "zstd") -> None:
    """A file for each shard; rows meet by shard, sorted as they were numbered."""
    df.repartition(F.col(shard)).write.partitionBy(shard).option("compression", compression).parquet(path)


def write_images(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """image struct<bytes, path>, text and prompt."""
    df.select(F.struct(F.col("content").alias("bytes"), F.col("path").alias("path")).alias("image"), "text", "prompt").write.option("compression", compression).parquet(path)


def require_valid(parsed: DataFrame) -> DataFrame:
    """One row: the first malformed line's number, or null."""
    return parsed.where("_doc is null").agg(F.min("_pos").alias("first_bad"))


def raise_if_invalid(parsed: DataFrame) -> None:
    """Fail at the first malformed line, with its number from 1."""
    bad = require_valid(parsed).first().first_bad
    if bad is not None:
        raise ValueError(f"line {bad + 1} is not valid JSON")


# Fixed value: the prompt of images that come without one.
DEFAULT_PROMPT = "Describe the image accurately and in detail."


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def write_named_shards(df: DataFrame, path: str, pos: str, rows: int, images: DataFrame | None = None, key: str = "path", default_prompt: str = DEFAULT_PROMPT, compression: str = "zstd") -> DataFrame:
    """Parquet files train-00000-of-0000n.parquet of `rows` rows each along pos (gapless from 0). Rows get their shard before
    those without an image (path, content) are dropped. Returns file and n. Files are written as parts and then renamed."""
    from dialoom.operators.reshape import shards

    dealt = shards(df, pos, rows)
    if images is not None:
        dealt = dealt.join(images.select(key, "content"), key)
    if "prompt" in dealt.columns:
        dealt = dealt.withColumn("prompt", F.coalesce("prompt", F.lit(default_prompt)))
    dealt.repartitionByRange("shard", pos).sortWithinPartitions("shard", pos).drop("shard").write.partitionBy("file").option("compression", compression).parquet(path)
    spark = df.sparkSession
    files, folder = _files(spark, path)
    joined: list[tuple[str, int]] = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if not name.startswith("file="):
            continue
        parts = sorted((p.getPath() for p in files.listStatus(status.getPath())), key=lambda p: p.getName())
        for k, part in enumerate(parts):
            target = name.removeprefix("file=")
            files.rename(part, spark._jvm.org.apache.hadoop.fs.Path(folder, target if not k else target.replace(".parquet", f"-{k}.parquet")))
        joined.append((name.removeprefix("file="), len(parts)))
        files.delete(status.getPath(), True)
    return spark.createDataFrame(joined, "file string, parts int")


class Uploader(Protocol):
    def __call__(self, path: str, name: str) -> None: ...


class FolderUploader:
    """Takes note of what it is given, in place of a hub."""

    def __init__(self) -> None:
        self.names: list[str] = []

    def __call__(self, path: str, name: str) -> None:
        self.names.append(name)


def upload(spark: SparkSession, path: str, uploader: Uploader, suffix: str = ".parquet") -> list[str]:
    """Hand every file of a folder to the uploader, by name; only names pass through the driver."""
    files, folder = _files(spark, path)
    names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isFile() and s.getPath().getName().endswith(suffix))
    for name in names:
        uploader(f"{path}/{name}", name)
    return names


def write_array(df: DataFrame, path: str, order: str, *columns: str) -> None:
    """One JSON array of objects in one file: lines stream through a single writer, which a single file takes."""
    from dialoom.operators.reshape import numbered

    lines = numbered(df.select(order, json_line(*(columns or df.columns)).alias("line")), order, name="_at")
    last = lines.agg(F.max("_at").alias("_last"))
    text = F.concat(F.when(F.col("_at") == 0, "[").otherwise(","), "line", F.when(F.col("_at") == F.col("_last"), "]").otherwise(""))
    lines.join(F.broadcast(last)).select("_at", text.alias("value")).repartitionByRange(1, "_at").sortWithinPartitions("_at").select("value").write.text(path)


def write_splits(splits: dict[str, DataFrame], folder: str, name: str) -> list[str]:
    """<name>_<split>.jsonl for each split, without images."""
    made = []
    for split, df in splits.items():
        made.append(f"{folder}/{name}_{split}.jsonl")
        write_jsonl(text_only(df), made[-1])
    return made


def mounted(path: str) -> str:
    """A folder's path for Python's own files: without its scheme if that is file, else there is none."""
    found = re.sub(r"^file:/*", "/", path)
    if "://" in found:
        raise ValueError(f"files of their own need a folder that all executors mount, not {path}")
    return found


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """A file of its own for each row, in a folder that all executors mount. Returns name and bytes. A task that runs again
    writes the same files again."""
    folder = mounted(folder)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            for n, data in zip(frame["name"], frame["content"], strict=True):
                with open(os.path.join(folder, os.path.basename(n)), "wb") as f:
                    f.write(data)
            yield pd.DataFrame({"name": frame["name"], "bytes": [len(x) for x in frame["content"]]})

    return df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInPandas(write, "name string, bytes long")


def numbered_images(df: DataFrame, pos: str, first: int = 0, path: str = "path", caption: str = "caption") -> DataFrame:
    """file_name (00000000.png, ... from `first` along pos) and metadata, the JSON line of an image folder, with the other
    columns: for write_files() and a metadata.jsonl that is appended to."""
    name = F.format_string("%08d.png", F.col(pos) + first)
    given = [F.col("prompt_metadata")] if "prompt_metadata" in df.columns else []
    line = F.to_json(F.struct(name.alias("file_name"), F.col(caption).alias("text"), F.element_at(F.split(path, "/"), -1).alias("original_filename"), *given))
    return df.withColumn("file_name", name).withColumn("metadata", line)


def harvested_files(items: DataFrame, id_col: str = "id", url: str = "url", content: str = "content", prompt: str = "prompt") -> DataFrame:
    """name and content of two files for each item: <id><extension> and <id>.txt."""
    from dialoom.functions.text import image_extension

    key = F.col(id_col).cast("string")
    image = F.struct(F.concat(key, image_extension(url)).alias("name"), F.col(content).cast("binary").alias("content"))
    text = F.struct(F.concat(key, F.lit(".txt")).alias("name"), F.coalesce(F.col(prompt), F.lit("")).cast("binary").alias("content"))
    return items.select(F.explode(F.array(image, text)).alias("f")).select("f.*")


def write_index(index: DataFrame, path: str) -> None:
    """tensor and file as the weight map of an index file, sorted by tensor: one line, as the format has it."""
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct("tensor", "file"))))
    index.groupBy().agg(whole.alias("weight_map")).select(json_line("weight_map").alias("value")).coalesce(1).write.text(path)


def group_report(groups: DataFrame) -> DataFrame:
    """Duplicate groups as JSON lines."""
    return groups.select(json_line(*groups.columns).alias("value"))


def text_only(df: DataFrame) -> DataFrame:
    """Without binary columns and structs that hold them."""
    return df.select(*(f"`{f.name}`" for f in df.schema if "binary" not in f.dataType.simpleString()))

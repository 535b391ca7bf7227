"""Scans: tolerant and strict JSON, text samples, phrases, images, metadata and model files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dialoom.functions.text import mime_type, strip
from dialoom.operators.reshape import numbered

IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff"]
# Column names that hold images and texts, in order of preference.
IMAGE_COLUMNS = ["image", "img", "picture", "photo"]
TEXT_COLUMNS = ["text", "caption", "description", "prompt", "label"]
# Keys that a prompt is looked for under.
PROMPT_KEYS = ["prompt", "Prompt", "positivePrompt", "positive_prompt", "positive", "Positive prompt", "caption", "description"]
# What the names of caption columns hold.
CAPTION_NAMES = "text caption captions description descriptions label labels annotation annotations alt_text title titles summary summaries content".split()


# Folders that aren't searched for datasets.
IGNORED_FOLDERS = ["venv", ".venv", "__pycache__", ".git", ".idea", ".vscode", "node_modules"]
UNDECODED = "\ufffd"


def lines(spark: SparkSession, path: str, ignore_bad_bytes: bool = False) -> DataFrame:
    """_file, _pos (gapless, by file and line) and _raw of text files. Bytes that aren't UTF-8 come as U+FFFD, or not at all."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), (F.replace(F.make_valid_utf8("value"), F.lit(UNDECODED), F.lit("")) if ignore_bad_bytes else F.col("value")).alias("_raw"))
    return numbered(rows, "_file", "_block", "_line").select("_file", "_pos", "_raw")


def _checked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lines that json.loads accepts, as JSON without NaN or double keys; null for others."""

    def one(line: str | None) -> str | None:
        try:
            found = json.loads(line)
        except (TypeError, ValueError):
            return None
        if "NaN" in line or "Infinity" in line:
            found = _finite(found)
        return json.dumps(found, ensure_ascii=False, separators=(",", ":"))

    for x in batches:
        yield x.map(one)


def _finite(x):
    if isinstance(x, dict):
        return {k: _finite(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_finite(v) for v in x]
    return None if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))) else x


def parsed(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Add _doc (VARIANT), null where the line is malformed. Strict parsing is Python's; the other is Spark's own, which also
    takes a valid start of a line."""
    raw = F.col("_raw")
    source = F.pandas_udf(_checked, StringType())(raw) if strict else F.when(strip(raw) != "", raw)
    return rows.withColumn("_doc", F.try_parse_json(source))


def jsonl(spark: SparkSession, path: str, strict: bool = True, fail_fast: bool = False) -> DataFrame:
    """Non-blank lines with their documents; fail_fast raises at a malformed one."""
    rows = parsed(lines(spark, path).where(strip("_raw") != ""), strict)
    if fail_fast:
        rows = rows.withColumn("_doc", F.when(F.col("_doc").isNull(), F.raise_error(F.concat(F.lit("malformed line "), F.col("_pos").cast("string"))).cast("variant")).otherwise(F.col("_doc")))
    return rows


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """_file, _pos, _raw and _doc of whole JSON files: the items of arrays, others as one; files that don't parse are read by
    line, objects only."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("_raw"))
    docs = parsed(whole)
    is_array = F.schema_of_variant("_doc").startswith("ARRAY")
    items = docs.where(F.col("_doc").isNotNull() & is_array).selectExpr("_file", "posexplode(cast(_doc AS array<variant>)) AS (_k, _doc)").select("_file", "_k", F.to_json("_doc").alias("_raw"), "_doc")
    single = docs.where(F.col("_doc").isNotNull() & ~is_array).select("_file", F.lit(0).alias("_k"), "_raw", "_doc")
    by_line = parsed(docs.where("_doc is null").select("_file", F.posexplode(F.split("_raw", "\n")).alias("_k", "_raw")).where(strip("_raw") != ""))
    objects = by_line.where(F.col("_doc").isNull() | F.schema_of_variant("_doc").startswith("OBJECT")).select("_file", "_k", "_raw", "_doc")
    every = items.union(single).union(objects).withColumn("_doc", F.to_json("_doc"))  # a variant can't be sorted through a shuffle by others
    return numbered(every, "_file", "_k").select("_file", "_pos", "_raw", F.try_parse_json("_doc").alias("_doc"))


def load(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".jsonl"):
        return jsonl(spark, path)
    if path.endswith(".json"):
        return json_documents(spark, path)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def text_column(df: DataFrame, column: str = "text") -> str:
    """The named column, or the only one."""
    if column in df.columns:
        return column
    if len(df.columns) == 1:
        return df.columns[0]
    raise ValueError(f"no column {column} among {df.columns}")


def samples(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """text of .txt (without blanks and # comments), .jsonl, .json, .parquet or .csv."""
    if path.endswith((".jsonl", ".json")):
        docs = load(spark, path)
        found = F.coalesce(F.try_variant_get("_doc", f"$.{column}", "string"), F.when(F.schema_of_variant("_doc") == "STRING", F.try_variant_get("_doc", "$", "string")))
        return docs.select(found.alias("text")).where("text is not null")
    if path.endswith((".parquet", ".csv")):
        df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
        return df.select(F.col(text_column(df, column)).cast("string").alias("text")).where("text is not null")
    return spark.read.text(path).select(strip("value").alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("#"))


def phrases(spark: SparkSession, *paths: str) -> DataFrame:
    """phrase and _pos: trimmed, without blanks, each at its first place."""
    rows = lines(spark, list(paths)).select(strip("_raw").alias("phrase"), "_pos").where("phrase <> ''")
    return rows.groupBy("phrase").agg(F.min("_pos").alias("_pos"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of image files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(IMAGE_EXTENSIONS)).select("path", "length", "content")


def pick_column(columns: list[str], wanted: list[str]) -> str | None:
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[w] for w in wanted if w in low), None)


def parquet_images(spark: SparkSession, path: str) -> DataFrame:
    """content, path, text and prompt of image tables whose image is a struct<bytes, path> or bytes; null images go."""
    df = spark.read.parquet(path)
    image, text = pick_column(df.columns, IMAGE_COLUMNS), pick_column([c for c in df.columns if c != "prompt"], TEXT_COLUMNS)
    if image is None:
        raise ValueError(f"no image column among {df.columns}")
    nested = dict(df.dtypes)[image].startswith("struct")
    content = F.col(f"{image}.bytes") if nested else F.col(image)
    where = F.col(f"{image}.path") if nested else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    return df.select(content.alias("content"), where.alias("path"), (F.col(text) if text else none).alias("text"), (F.col("prompt") if "prompt" in df.columns else none).alias("prompt")).where("content is not null")


def metadata(rows: DataFrame) -> DataFrame:
    """Salvage image metadata lines: add `reason` (kept, blank, stray_fragment, not_json, not_object, missing_field), file_name and
    text. A valid start with junk behind it is kept."""
    raw = strip("_raw")
    hints = sum((F.contains(raw, F.lit(h)).cast("int") for h in ('"model"', '"temperature"', '"prompt"', '"file_name"')), F.lit(0))
    doc = F.try_parse_json(F.when(raw != "", raw))
    out = rows.withColumn("_doc", doc).withColumn("file_name", F.try_variant_get("_doc", "$.file_name", "string")).withColumn("text", F.try_variant_get("_doc", "$.text", "string"))
    opens = raw.startswith("{") | raw.startswith("[")
    reason = (
        F.when(raw == "", "blank").when(~opens & (hints >= 2), "stray_fragment").when(~opens, "not_json").when(F.col("_doc").isNull(), "not_json")
        .when(~F.schema_of_variant("_doc").startswith("OBJECT"), "not_object").when(F.col("file_name").isNull() | F.col("text").isNull(), "missing_field").otherwise("kept")
    )
    return out.withColumn("reason", reason)


def prompt_text(doc: str = "_doc") -> Column:
    """The first prompt key with text, or the document as JSON."""
    found = [F.nullif(strip(F.try_variant_get(doc, f"$['{k}']", "string")), F.lit("")) for k in PROMPT_KEYS]
    return F.coalesce(*found, F.to_json(F.col(doc)))


def caption_column(columns: list[tuple[str, str | None]], patterns: list[str] | None = None) -> str | None:
    """The first column, of (name, sample), whose name looks like captions or whose sample is a text of over ten characters."""
    wanted = patterns or CAPTION_NAMES
    for name, sample in columns:
        if any(p in name.lower() for p in wanted):
            return name
        if sample is not None and len(sample) > 10 and name.lower() not in ("id", "path", "url", "file_name"):
            return name
    return None


def listed(spark: SparkSession, path: str) -> DataFrame:
    """_pos and item of a YAML file that is a list of plain or quoted scalars; comments and other lines are skipped."""
    raw = F.regexp_extract("_raw", r"^\s*-\s+(.*?)\s*$", 1)
    quoted = F.regexp_extract(raw, r"^(?:'((?:[^']|'')*)'|\"((?:[^\"\\\\]|\\\\.)*)\")\s*(?:#.*)?$", 0)
    single, double = F.replace(F.regexp_extract(raw, r"^'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'")), F.regexp_replace(F.regexp_extract(raw, r'^"((?:[^"\\]|\\.)*)"', 1), r"\\(.)", "$1")
    plain = strip(F.regexp_replace(raw, r"\s+#.*$", ""))
    item = F.when(quoted == "", plain).when(raw.startswith("'"), single).otherwise(double)
    return lines(spark, path).where(F.col("_raw").rlike(r"^\s*-\s+\S")).select("_pos", item.alias("item")).where("item <> ''")


def dataset_roots(spark: SparkSession, *parents: str, ignored: list[str] = IGNORED_FOLDERS) -> DataFrame:
    """root and _pos: folders below the parents, each once and in their order, that hold metadata.jsonl and images/ with files.
    A parent that is a root itself isn't searched further. Only paths are read."""
    found = None
    for k, parent in enumerate(parents):
        paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(parent).select("path").where(~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in ignored) + ")/"))
        meta = paths.where(F.col("path").endswith("/metadata.jsonl")).select(F.regexp_replace("path", "/metadata\\.jsonl$", "").alias("root"))
        images = paths.where(F.contains("path", F.lit("/images/"))).select(F.regexp_extract("path", "^(.*?)/images/[^/]*$", 1).alias("root")).distinct()
        itself = F.regexp_replace("root", "^file:/*", "/") == re.sub("^file:/*", "/", parent).rstrip("/")
        own = meta.join(images, "root", "left_semi").select("root", F.lit(k).alias("_parent"), itself.alias("_itself"))
        alone = own.agg(F.coalesce(F.bool_or("_itself"), F.lit(False)).alias("_alone"))  # one row
        own = own.join(F.broadcast(alone)).where(~F.col("_alone") | F.col("_itself")).select("root", "_parent")
        found = own if found is None else found.union(own)
    return found.groupBy("root").agg(F.min("_parent").alias("_parent")).select("root", F.col("_parent").alias("_pos"))


def choose_split(splits: list[str]) -> str:
    """train where there is one, else the first."""
    if not splits:
        raise ValueError("no splits")
    return "train" if "train" in splits else splits[0]


def data_url(content: Column | str, path: Column | str) -> Column:
    """Bytes as a base64 data URL, with the type that the path's extension says."""
    data = F.col(content) if isinstance(content, str) else content
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.base64(data))


def stamped(name: Column | str, at: Column, extension: str) -> Column:
    """A file name with a time stamp: name_20240131_235959.extension."""
    return F.concat(F.col(name) if isinstance(name, str) else name, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(f".{extension}"))


def checked_catalog(catalog: DataFrame) -> DataFrame:
    """The catalog, failing at a tensor that two files hold."""
    times = catalog.groupBy("tensor").agg(F.count("*").alias("_n"))
    told = F.raise_error(F.concat(F.lit("tensor in two files: "), F.col("tensor")))
    return catalog.join(times, "tensor").withColumn("file", F.when(F.col("_n") > 1, told.cast("string")).otherwise(F.col("file"))).drop("_n")


def tensor_catalog(spark: SparkSession, path: str) -> DataFrame:
    """tensor, file, dtype and shape from the headers of safetensors files: eight bytes of length, then JSON."""
    files = spark.read.format("binaryFile").load(path)
    size = F.conv(F.hex(F.reverse(F.substring("content", 1, 8))), 16, 10).cast("int")
    header = F.decode(F.substring(F.col("content"), F.lit(9), size), "utf-8")
    each = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.explode(F.from_json(header, "map<string,struct<dtype:string,shape:array<long>>>")).alias("tensor", "t"))
    return each.where("tensor <> '__metadata__'").select("tensor", "file", "t.dtype", "t.shape")


def weight_map(spark: SparkSession, path: str) -> DataFrame:
    """tensor and file of an index file."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "weight_map map<string,string>").alias("d"))
    return doc.select(F.explode("d.weight_map").alias("tensor", "file"))


def rewritten_index(index: DataFrame) -> DataFrame:
    return index.withColumn("file", F.regexp_replace("file", r"^pytorch_model(.*)\.bin$", "model$1.safetensors"))

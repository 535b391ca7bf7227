"""Queries that write and read again: sources, sinks, streams, images and generated rows. Each makes its files from a whole table
in the shared folder and returns what is read back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.storage import new_path, written
from dialoom.functions.turns import nest, values_text
from dialoom.operators import filters, formats, generation, images, ngrams, plugins, repair, reshape, stats, vectors
from dialoom.plans.base import Registry, table
from dialoom.sources import scan, sinks
from dialoom.streaming import dedup as stream

REG = Registry()


def lines_of(df: DataFrame, value: Column, tag: str, *order: str) -> str:
    """A text file of one line a row, in order."""
    path = new_path(df.sparkSession, tag)
    df.orderBy(*order).select(value.alias("value")).coalesce(1).write.text(path)
    return path


def member(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("_doc", f"$.{name}", kind)


# Scans.


@REG.query("jsonl_roundtrip", "SELECT conv_id, turn, role, sha256(text) AS said FROM conversations")
def jsonl_roundtrip(spark, sf_dir):
    path = new_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return scan.jsonl(spark, path, fail_fast=True).select(member("conv_id", "long").alias("conv_id"), member("turn", "long").alias("turn"), member("role").alias("role"), F.sha2(member("text"), 256).alias("said"))


RAW = "CASE doc_id % 5 WHEN 0 THEN '{\"doc_id\":' || doc_id || '}' WHEN 1 THEN '{\"a\":1' WHEN 2 THEN '   ' WHEN 3 THEN '{''a'':1}' ELSE '{\"doc_id\":' || doc_id || ',\"x\":NaN}' END"


@REG.query("malformed_lines", "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos, CASE WHEN doc_id % 5 IN (0, 4) THEN doc_id END AS doc_id, doc_id % 5 IN (0, 4) AS ok FROM documents QUALIFY doc_id % 5 <> 2")
def malformed_lines(spark, sf_dir):
    """Tolerant scanning: blank lines go, malformed ones stay with their number and no document."""
    docs = table(spark, sf_dir, "documents")
    path = lines_of(docs, F.expr(RAW), "raw", "doc_id")
    return scan.jsonl(spark, path).select(F.col("_pos").alias("pos"), member("doc_id", "long").alias("doc_id"), F.col("_doc").isNotNull().alias("ok"))


@REG.query("undecoded_bytes", "SELECT doc_id, 'a' || doc_id || 'b' AS said FROM documents")
def undecoded_bytes(spark, sf_dir):
    """Bytes that aren't UTF-8 are left out of a line."""
    docs = table(spark, sf_dir, "documents")
    raw = F.concat(F.concat(F.lit("a"), F.col("doc_id").cast("string")).cast("binary"), F.unhex(F.lit("FF")), F.lit("b").cast("binary"))
    path = new_path(spark, "bytes")
    sinks.write_files(docs.groupBy((F.col("doc_id") % 4).alias("k")).agg(F.concat_ws(",", F.collect_list(F.hex(F.concat(raw, F.lit("\n").cast("binary"))))).alias("h")).select(F.concat(F.lit("f"), "k", F.lit(".txt")).alias("name"), F.unhex(F.replace("h", F.lit(","), F.lit(""))).alias("content")), path).count()
    found = scan.lines(spark, path, ignore_bad_bytes=True).where("_raw <> ''")
    return found.select(F.regexp_extract("_raw", r"^a(\d+)b$", 1).cast("long").alias("doc_id"), F.col("_raw").alias("said"))


@REG.query("json_array_file", "SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS BIGINT) AS pos, item_id, sha256(text) AS said FROM benchmark")
def json_array_file(spark, sf_dir):
    """Rows combined into one JSON array, and that read as documents."""
    path = new_path(spark, "array")
    sinks.write_array(table(spark, sf_dir, "benchmark"), path, "item_id")
    return scan.json_documents(spark, path).select(F.col("_pos").alias("pos"), member("item_id", "long").alias("item_id"), F.sha2(member("text"), 256).alias("said"))


SAMPLE = "regexp_replace(text, '[^A-Za-z]+', ' ', 'g')"


@REG.query("text_samples", f"SELECT trim({SAMPLE}) AS text FROM benchmark WHERE item_id % 4 NOT IN (1, 2) AND trim({SAMPLE}) <> ''")
def text_samples(spark, sf_dir):
    """A text file with comments and blank lines."""
    said = F.regexp_replace("text", "[^A-Za-z]+", " ")
    k = F.col("item_id") % 4
    return scan.samples(spark, lines_of(table(spark, sf_dir, "benchmark"), F.when(k == 1, F.concat(F.lit("# "), said)).when(k == 2, "  ").otherwise(F.concat(F.lit(" "), said, F.lit("\t"))), "samples", "item_id"))


@REG.query("phrase_list", "WITH p AS (SELECT regexp_extract(text, '^[A-Za-z]+') AS phrase, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark) SELECT phrase, CAST(min(k) AS BIGINT) AS pos FROM p WHERE trim(phrase) <> '' GROUP BY phrase")
def phrase_list(spark, sf_dir):
    path = lines_of(table(spark, sf_dir, "benchmark"), F.concat(F.lit("  "), F.regexp_extract("text", "^[A-Za-z]+", 0)), "phrases", "item_id")
    return scan.phrases(spark, path).select("phrase", F.col("_pos").alias("pos"))


@REG.query("exclusion_list", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING NOT bool_or(contains(coalesce(text, ''), 'tionth')) AND NOT bool_or(contains(coalesce(text, ''), 'Erou')) AND NOT bool_or(contains(coalesce(text, ''), 'it''s so'))")
def exclusion_list(spark, sf_dir):
    """A YAML list of strings, and the conversations that hold none of them."""
    path = new_path(spark, "yaml")
    rows = spark.createDataFrame([(0, "# strings"), (1, "- tionth  # a comment"), (2, '- "Erou"'), (3, "- 'it''s so'"), (4, "other: 1")], "k int, v string")
    rows.orderBy("k").select(F.col("v").alias("value")).coalesce(1).write.text(path)
    found = [r.item for r in scan.listed(spark, path).orderBy("_pos").collect()]  # a short list of a user's own
    return filters.drop_with_strings(nest(table(spark, sf_dir, "conversations")), found).select("conv_id")


def document_files(spark: SparkSession, sf_dir: str, extension: str = ".png") -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string"), F.when(F.col("item_id") % 3 == 0, ".txt").otherwise(extension)).alias("name"), F.col("text").cast("binary").alias("content"))


@REG.query("image_files", "SELECT 'i' || item_id || '.png' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS length, md5(text) AS said FROM benchmark WHERE item_id % 3 <> 0")
def image_files(spark, sf_dir):
    """Only files with an image's extension are listed."""
    path = new_path(spark, "images")
    sinks.write_files(document_files(spark, sf_dir), path).count()
    return scan.images(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.md5("content").alias("said"))


@REG.query("image_table", "SELECT item_id || '.png' AS path, md5(text) AS said, 'c' || item_id AS text, CASE WHEN item_id % 2 = 0 THEN 'p' END AS prompt FROM benchmark WHERE item_id % 5 <> 0")
def image_table(spark, sf_dir):
    """An image table of structs, with null images that go."""
    items = table(spark, sf_dir, "benchmark")
    path = new_path(spark, "imagetable")
    rows = items.select(F.when(F.col("item_id") % 5 != 0, F.col("text").cast("binary")).alias("content"), F.concat(F.col("item_id").cast("string"), F.lit(".png")).alias("path"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("text"), F.when(F.col("item_id") % 2 == 0, "p").alias("prompt"))
    sinks.write_images(rows, path)
    return scan.parquet_images(spark, path).select("path", F.md5("content").alias("said"), "text", "prompt")


@REG.query("dataset_roots", "SELECT * FROM (VALUES ('a', CAST(0 AS INTEGER)), ('c', 0)) AS v(root, pos)")
def dataset_roots(spark, sf_dir):
    top = new_path(spark, "roots")
    for folder in ("a", "b", "c", "node_modules/d"):
        files = spark.createDataFrame([("metadata.jsonl", b"{}")], "name string, content binary")
        sinks.write_files(files, f"{top}/{folder}").count()
        if folder != "b":
            sinks.write_files(document_files(spark, sf_dir), f"{top}/{folder}/images").count()
    return scan.dataset_roots(spark, top).select(F.element_at(F.split("root", "/"), -1).alias("root"), F.col("_pos").alias("pos"))


@REG.query("caption_columns", "SELECT * FROM (VALUES ('documents', 'text'), ('pages', 'html'), ('benchmark', 'text'), ('conversations', 'role_label')) AS v(name, caption)")
def caption_columns(spark, sf_dir):
    """Caption columns by name or by a sample of the first row."""
    found = []
    for name in ("documents", "pages", "benchmark", "conversations"):
        df = table(spark, sf_dir, name)
        if name == "conversations":
            df = df.withColumnsRenamed({"role": "role_label"})
        first = df.limit(1).collect()[0]  # one row
        found.append((name, scan.caption_column([(c, first[c] if isinstance(first[c], str) else None) for c in df.columns])))
    return spark.createDataFrame(found, "name string, caption string")


@REG.query("prompt_texts", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'p' || page_id WHEN 1 THEN 'q' WHEN 2 THEN 'd' ELSE '{\"seed\":' || page_id || '}' END AS prompt FROM pages")
def prompt_texts(spark, sf_dir):
    k, own = F.col("page_id") % 4, F.col("page_id").cast("string")
    doc = F.when(k == 0, F.concat(F.lit('{"description":"d","prompt":" p'), own, F.lit(' "}'))).when(k == 1, '{"prompt":"  ","Positive prompt":"q"}').when(k == 2, '{"description":"d","text":"t"}').otherwise(F.concat(F.lit('{"seed":'), own, F.lit("}")))
    return table(spark, sf_dir, "pages").select("page_id", F.try_parse_json(doc).alias("_doc")).select("page_id", scan.prompt_text().alias("prompt"))


def _header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model file for each nation's region: eight bytes of length, a JSON header with a tensor for each nation, data."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    tensor = F.concat(F.lit('"t'), F.col("n_nationkey").cast("string"), F.lit('":{"dtype":"F32","shape":['), F.col("n_nationkey").cast("string"), F.lit(",4],\"data_offsets\":[0,16]}"))
    head = n.groupBy("n_regionkey").agg(F.concat(F.lit('{"__metadata__":{"format":"pt"},'), F.array_join(F.array_sort(F.collect_list(tensor)), ","), F.lit("}")).alias("h"))
    size = F.reverse(F.unhex(F.lpad(F.hex(F.length("h")), 16, "0")))
    return head.select(F.concat(F.lit("pytorch_model-"), F.col("n_regionkey").cast("string"), F.lit(".safetensors")).alias("name"), F.concat(size, F.col("h").cast("binary"), F.unhex(F.lit("00" * 64))).alias("content"))


@REG.query("tensor_headers", "SELECT 't' || n_nationkey AS tensor, 'pytorch_model-' || n_regionkey || '.safetensors' AS file, 'F32' AS dtype, CAST(n_nationkey AS BIGINT) AS n_rows FROM nation")
def tensor_headers(spark, sf_dir):
    path = new_path(spark, "tensors")
    sinks.write_files(_header(spark, sf_dir), path).count()
    return scan.checked_catalog(scan.tensor_catalog(spark, path)).select("tensor", "file", "dtype", F.get("shape", F.lit(0)).alias("n_rows"))


@REG.query("index_files", "SELECT 't' || n_nationkey AS tensor, 'model-' || n_regionkey || '.safetensors' AS file FROM nation")
def index_files(spark, sf_dir):
    """An index file written, read and its file names brought up to date."""
    path = new_path(spark, "index")
    n = table(spark, sf_dir, "nation")
    sinks.write_index(n.select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tensor"), F.concat(F.lit("pytorch_model-"), F.col("n_regionkey").cast("string"), F.lit(".bin")).alias("file")), path)
    return scan.rewritten_index(scan.weight_map(spark, path))


# Sinks.


@REG.query("parquet_roundtrip", "SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events")
def parquet_roundtrip(spark, sf_dir):
    """Parquet to JSONL (NaN as null) and back."""
    source, lines, back = (new_path(spark, x) for x in ("source", "lines", "back"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    e.write.parquet(source)
    sinks.parquet_to_jsonl(spark, source, lines)
    sinks.jsonl_to_parquet(spark, lines, back)
    return spark.read.parquet(back).select("event_id", "user_id", "value")


@REG.query("conversation_files", "WITH n AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT CAST(len(t) AS BIGINT) AS n, sha256(array_to_string(t, '')) AS said FROM n")
def conversation_files(spark, sf_dir):
    """Conversations alone, as canonical lines."""
    path = new_path(spark, "conversations")
    sinks.write_conversations(nest(table(spark, sf_dir, "conversations")), path)
    turns = formats.as_turns(formats.pairs_at("_doc", "$.conversations", "from", "value"))
    return scan.jsonl(spark, path).select(turns.alias("t")).select(F.size("t").cast("long").alias("n"), F.sha2(values_text("t"), 256).alias("said"))


@REG.query("first_bad_line", "SELECT min(p) FILTER (bad) AS first_bad FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, doc_id % 97 = 50 AS bad FROM documents)")
def first_bad_line(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 97 == 50, "{").otherwise('{"a":1}')
    return sinks.require_valid(scan.jsonl(spark, lines_of(table(spark, sf_dir, "documents"), raw, "valid", "doc_id")))


@REG.query("verdict_files", "SELECT doc_id, CASE WHEN n_chars <= 2000 THEN 'kept' ELSE 'long' END AS verdict FROM documents")
def verdict_files(spark, sf_dir):
    path = new_path(spark, "verdicts")
    sinks.write_split(stats.split_by_limit(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 2000), path)
    return spark.read.parquet(path).select("doc_id", "verdict")


@REG.query("split_files", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_files(spark, sf_dir):
    """A file for each split, without images; the chosen split comes first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").cast("binary").alias("image"))
    splits = {"test": docs.where("doc_id % 4 = 0"), "train": docs.where("doc_id % 4 <> 0")}
    first = scan.choose_split(list(splits))
    paths = dict(zip(splits, sinks.write_splits(splits, new_path(spark, "splits"), "docs"), strict=True))
    read = [scan.jsonl(spark, paths[k]).select(member("doc_id", "long").alias("doc_id"), F.lit(k).alias("split")) for k in [first, *(x for x in splits if x != first)]]
    return read[0].union(read[1])


PACKED = """WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark), t AS (SELECT max(pos) // 30 + 1 AS total FROM p)
SELECT printf('train-%05d-of-%05d.parquet', pos // 30, total) AS file, CAST(count(*) AS BIGINT) AS n, CAST(min(item_id) AS BIGINT) AS first FROM p, t WHERE item_id % 7 <> 3 GROUP BY ALL"""


def packed(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "packed")
    rows = reshape.numbered(table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("images/"), F.col("item_id").cast("string"), F.lit(".png")).alias("path"), F.lit(None).cast("string").alias("prompt")), "item_id")
    there = table(spark, sf_dir, "benchmark").where("item_id % 7 <> 3").select(F.concat(F.lit("images/"), F.col("item_id").cast("string"), F.lit(".png")).alias("path"), F.col("text").cast("binary").alias("content"))
    sinks.write_named_shards(rows, path, "_pos", 30, there)
    return path


@REG.query("packed_shards", PACKED)
def packed_shards(spark, sf_dir):
    """Shards by exact names: rows are numbered before those without an image go."""
    read = spark.read.parquet(packed(spark, sf_dir)).select("item_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    return read.groupBy("file").agg(F.count("*").alias("n"), F.min("item_id").alias("first"))


@REG.query("uploaded_shards", PACKED.replace("AS file, CAST(count(*) AS BIGINT) AS n, CAST(min(item_id) AS BIGINT) AS first", "AS file"))
def uploaded_shards(spark, sf_dir):
    uploader = sinks.FolderUploader()
    sinks.upload(spark, packed(spark, sf_dir), uploader)
    return spark.createDataFrame([(n,) for n in uploader.names], "file string")


@REG.query("numbered_images", "SELECT printf('%08d.png', row_number() OVER (ORDER BY item_id) + 6) AS file_name, 'c' || item_id AS text, item_id || '.jpg' AS original_filename FROM benchmark")
def numbered_images(spark, sf_dir):
    """Images under running numbers from 7, and the metadata lines beside them."""
    rows = reshape.numbered(table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("in/"), F.col("item_id").cast("string"), F.lit(".jpg")).alias("path"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("caption"), F.col("text").cast("binary").alias("content")), "item_id")
    made = written(sinks.numbered_images(rows, "_pos", 7), "numbered-images")
    folder, lines = new_path(spark, "folder"), new_path(spark, "metadata")
    sinks.write_files(made, folder, "file_name").count()
    made.select(F.col("metadata").alias("value")).write.text(lines)
    names = scan.images(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    read = scan.metadata(scan.lines(spark, lines)).where("reason = 'kept'").select("file_name", "text", member("original_filename").alias("original_filename"))
    return read.join(names, "file_name", "left_semi")


@REG.query("harvested_files", "SELECT page_id || CASE WHEN page_id % 2 = 0 THEN '.webp' ELSE '.jpg' END AS name, CAST(3 AS BIGINT) AS bytes FROM pages UNION ALL SELECT page_id || '.txt', CAST(1 + length(CAST(page_id AS VARCHAR)) AS BIGINT) FROM pages")
def harvested_files(spark, sf_dir):
    """An image and its prompt for each item."""
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, "http://x/y.webp?z=1").otherwise("http://x/y").alias("url"), F.lit("abc").cast("binary").alias("content"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("prompt"))
    return sinks.write_files(sinks.harvested_files(items), new_path(spark, "harvest"))


@REG.query("moved_names", "WITH b AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, CASE WHEN k = 0 THEN source || '.png' ELSE source || '__dup' || k || '.png' END AS target FROM b")
def moved_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("lang"), F.lit("/"), "source", F.lit(".png")).alias("path"))
    return reshape.unique_names(rows, "path", "doc_id", "__dup").select("doc_id", "target")


@REG.query("converted_files", "SELECT 'c' || (conv_id % 3) AS source, CASE conv_id % 3 WHEN 0 THEN 'sharegpt' WHEN 1 THEN 'huggingface' ELSE 'alpaca' END AS format, count(*) AS n, least(count(*), 3) AS n_preview FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY ALL")
def converted_files(spark, sf_dir):
    """Three files of three formats, one output for each and a preview."""
    chats = written(nest(table(spark, sf_dir, "conversations")), "chats")
    top = new_path(spark, "inputs")
    docs = [
        F.to_json(F.struct(F.col("turns").alias("conversations"))), F.to_json(F.struct(repair.to_messages("turns").alias("messages"))),
        F.to_json(F.struct(F.get("turns", F.lit(0))["value"].alias("instruction"), F.lit("").alias("input"), F.lit("o").alias("output"))),
    ]
    for k, doc in enumerate(docs):
        some = chats.where(F.col("conv_id") % 3 == k).groupBy().agg(F.array_join(F.array_sort(F.collect_list(doc)), "\n").alias("t"))  # one small file
        sinks.write_files(some.select(F.lit(f"c{k}.jsonl").alias("name"), F.col("t").cast("binary").alias("content")), top).count()
    done = formats.convert_files(scan.jsonl(spark, f"{top}/*.jsonl"), new_path(spark, "outputs"))
    return done.select("source", "format", "n", F.size("preview").cast("long").alias("n_preview"))


# Rules.


@REG.query("refusal_share", "WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (quality > 0.75) AS n_positive, count(*) FILTER (toxic > 0.75) AS n_negative FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT d.source, coalesce(n, 0) AS n, coalesce(n_positive, 0) AS n_positive, coalesce(n_negative, 0) AS n_negative, coalesce(n_positive, 0) = 0 AS kept FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN s USING (source)")
def refusal_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    scores = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("toxic").cast("double").alias("pos"), F.col("quality").cast("double").alias("neg"))
    return filters.refusal_share(docs.select("source").distinct(), scores, "source")


@REG.query("refusals_kept", "WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (toxic > 0.75) AS n_positive, count(*) FILTER (quality > 0.75) AS n_negative FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT d.source, coalesce(n, 0) AS n, coalesce(n_positive, 0) AS n_positive, coalesce(n_negative, 0) AS n_negative, coalesce(n_positive, 0) > 0 AS kept FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN s USING (source)")
def refusals_kept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    scores = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("toxic").cast("double").alias("pos"), F.col("quality").cast("double").alias("neg"))
    return filters.refusal_share(docs.select("source").distinct(), scores, "source", keep_refusals=True)


@REG.query("generation_verdicts", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'retry' WHEN 2 THEN 'refused' ELSE 'kept' END AS verdict FROM documents")
def generation_verdicts(spark, sf_dir):
    """Phrases at which a generation is given up or tried again, put into the texts."""
    k = F.col("doc_id") % 5
    lead = F.when(k == 0, "Upon further reflection, ").when(k == 1, "it sent shivers down ").when(k == 2, "I can't engage; shivers down ").otherwise("")
    return generation.verdicts(table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, "text").alias("t")), "t").select("doc_id", "verdict")


@REG.query("encodable_rows", "SELECT doc_id, true AS encodable FROM documents WHERE text IS NOT NULL")
def encodable_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", filters.encodable("text").alias("encodable")).where("encodable is not null")


@REG.query("requested_images", "SELECT event_id, ['None', 'Soft', 'Mature', 'X'][event_id % 4 + 1] AS level FROM events WHERE event_id % 4 < 3 AND user_id >= 5")
def requested_images(spark, sf_dir):
    level = F.get(F.array(*map(F.lit, filters.NSFW_LEVELS)), (F.col("event_id") % 4).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("nsfwLevel", level)
    return filters.requested(rows, "Mature", "5", time_col="user_id", sort=[F.desc("value")]).select("event_id", F.col("nsfwLevel").alias("level"))


@REG.query("request_sizes", "WITH s AS (SELECT doc_id, 100 + doc_id % 5000 AS w, 50 + doc_id % 3000 AS h, n_chars * 2000 AS b FROM documents) SELECT doc_id, CAST(floor(w * least(1.0, 2048.0 / greatest(w, h))) AS INTEGER) AS width, CAST(floor(h * least(1.0, 2048.0 / greatest(w, h))) AS INTEGER) AS height, ceil(b / 3) * 4 <= 20971520 AS fits FROM s")
def request_sizes(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", (100 + F.col("doc_id") % 5000).alias("w"), (50 + F.col("doc_id") % 3000).alias("h"), (F.col("n_chars") * 2000).alias("b"))
    return s.select("doc_id", filters.fits_request("w", "h", "b").alias("r")).select("doc_id", "r.*")


@REG.query("name_patterns", "SELECT page_id, contains(lower(url), 'example') OR contains(lower(url), 'news') AS matches FROM pages")
def name_patterns(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", filters.name_matches("url", ["Example", "NEWS"]).alias("matches"))


@REG.query("first_rows", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25")
def first_rows(spark, sf_dir):
    return reshape.first_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), 25, "source", "doc_id")


@REG.query("stamped_names", "SELECT event_id, event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jsonl' AS name FROM events")
def stamped_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scan.stamped("event_type", F.col("ts"), "jsonl").alias("name"))


@REG.query("data_urls", "SELECT item_id, 'data:' || CASE WHEN item_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END || ';base64,' || to_base64(encode(text)) AS url FROM benchmark")
def data_urls(spark, sf_dir):
    path = F.concat(F.col("item_id").cast("string"), F.when(F.col("item_id") % 2 == 0, ".PNG").otherwise(".xyz"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(scan.data_url(F.col("text").cast("binary"), path), r"\s", "").alias("url"))


@REG.query("role_ngrams", "WITH t AS (SELECT conv_id * 1000 + turn AS o, regexp_extract_all(lower(trim(regexp_replace(regexp_replace(translate(text, '‘’`', ''''''''), '[''\"]+', '\"', 'g'), '[\\s\\pZ\\x1C-\\x1F\\x85]+', ' ', 'g'))), '[\\p{L}\\p{N}\\p{M}_'']+|[^\\p{L}\\p{N}\\p{M}_\\s\\p{Z}\\x1C-\\x1F\\x85]') AS t FROM conversations WHERE role = 'assistant'), g AS (SELECT o, i, t[i:i + 2] AS g FROM (SELECT o, t, unnest(range(1, len(t) - 1)) AS i FROM t WHERE len(t) >= 3)) SELECT count(*) AS n, count(DISTINCT array_to_string(g, ' ')) AS n_distinct FROM g")
def role_ngrams(spark, sf_dir):
    """All trigrams that one role says, whatever the case of its name."""
    chats = nest(table(spark, sf_dir, "conversations")).withColumn("turns", F.transform("turns", lambda t: F.struct(F.upper(t["from"]).alias("from"), t["value"].alias("value"))))
    grams = ngrams.ngrams(ngrams.said_by(chats, "turns", ["gpt"], "conv_id"), "o", "text", 3, 3, stop_limit=3, punct_limit=3)
    return grams.agg(F.count("*").alias("n"), F.count_distinct(F.array_join("ngram", " ")).alias("n_distinct"))


# Vectors.


@REG.query("projected_vectors", "WITH e AS (SELECT vec_id, embedding, list_transform(range(1, 65), lambda i: 1.0 / 8) AS u FROM embeddings), d AS (SELECT vec_id, embedding, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) / 8)) AS d FROM e), p AS (SELECT vec_id, embedding, list_transform(range(1, 65), lambda i: embedding[i] - d / 8) AS p FROM d) SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(p, lambda x: x * x))) * p[1], 5) AS x FROM p")
def projected_vectors(spark, sf_dir):
    """Vectors without their part along a direction, scaled back to their size."""
    along = F.array(*[F.lit(1 / 8)] * 64)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    made = e.select("vec_id", vectors.renormed(F.array(vectors.projected_out("v", along)), F.array("v")).alias("m"))
    return made.select("vec_id", F.round(F.get(F.get("m", F.lit(0)), F.lit(0)), 5).alias("x"))


@REG.query("layer_weights", "SELECT vec_id, round(exp(-((label - 4.0) ** 2) / (2 * 1.5 * 1.5)), 6) AS weight FROM embeddings")
def layer_weights(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.layer_weight("label", 4.0, 1.5), 6).alias("weight"))


@REG.query("embedded_texts")
def embedded_texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", plugins.embed(F.col("text"), plugins.hashed_embedder()).alias("vector"))


# Images.


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey PNG for each document, of its first bytes over and over; copies of a text are copies of a picture."""

    @F.pandas_udf("binary")
    def drawn(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: images.encode_png(np.resize(np.frombuffer((x or " ").encode()[:4096] or b" ", np.uint8), (24, 31, 1))))

    return table(spark, sf_dir, "documents").select("doc_id", drawn("text").alias("content"))


@REG.query("difference_hashes")
def difference_hashes(spark, sf_dir):
    """Size and difference hash of PNG bytes."""
    return pictures(spark, sf_dir).select("doc_id", images.described("content").alias("d")).select("doc_id", "d.*")


@REG.query("hub_images", "SELECT printf('image_%06d.png', row_number() OVER (ORDER BY item_id) - 1) AS file_name, CASE item_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'd' ELSE '' END AS caption, item_id % 4 <> 0 AS fresh FROM benchmark")
def hub_images(spark, sf_dir):
    """Images and captions of a table, by the first caption column that says anything; cached files aren't fresh."""
    k = F.col("item_id") % 3
    rows = reshape.numbered(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("content"), F.lit("  ").alias("text"), F.when(k == 0, " c ").alias("caption"), F.when(k < 2, "d").alias("description")), "item_id")
    cached = rows.where("item_id % 4 = 0").select(F.format_string("image_%06d.png", "_pos").alias("file_name"))
    return generation.extracted_images(rows, "_pos", cached=cached).select("file_name", "caption", "fresh")


@REG.query("captioned_images")
def captioned_images(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".png")).alias("path"), F.col("text").cast("binary").alias("content"))
    done = rows.where("path < '2'").select("path", F.length("path").alias("index"))
    return generation.captioned(rows, generation.sized_captioner, ["short", "long", "plain"], done)


# Generated rows.

ANSWER = '[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]'
LONG_ANSWER = '[{"role":"user","content":"a"},{"role":"assistant","content":"b"},{"role":"user","content":"c"},{"role":"assistant","content":"d"}]'


def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest(table(spark, sf_dir, "conversations")).select("conv_id", repair.to_messages("turns").alias("messages"))


@REG.query("improved_or_extended", "SELECT conv_id, CAST(4 AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def improved_or_extended(spark, sf_dir):
    out = generation.improved_or_extended(message_rows(spark, sf_dir), plugins.ScriptedClient([LONG_ANSWER]), 1)
    return out.select("conv_id", F.size("combined").cast("long").alias("n"))


@REG.query("extended_messages", "WITH n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS s FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(n + 2 + (n - s) % 2 AS BIGINT) AS n FROM n")
def extended_messages(spark, sf_dir):
    """A pair more for each conversation; a closing reply where roles come out even."""
    out = plugins.extended(message_rows(spark, sf_dir), plugins.ScriptedClient([ANSWER]), 1)
    return out.select("conv_id", F.size("extended").cast("long").alias("n"))


@REG.query("new_conversations", "SELECT item_id, CAST(4 AS BIGINT) AS n, 'a|b|c|d' AS said FROM benchmark")
def new_conversations(spark, sf_dir):
    seeds = table(spark, sf_dir, "benchmark").select("item_id", F.array("text", "text", "text", "text").alias("examples"))
    out = generation.new_conversations(seeds, plugins.ScriptedClient([LONG_ANSWER]), "examples")
    return out.select("item_id", F.size("turns").cast("long").alias("n"), values_text("turns", "|").alias("said"))


@REG.query("single_replies", "SELECT DISTINCT conv_id, 'I understand.' AS reply FROM conversations")
def single_replies(spark, sf_dir):
    return generation.single_reply(message_rows(spark, sf_dir), plugins.ScriptedClient(["  \n"])).select("conv_id", "reply")


@REG.query("entry_files", "WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS pos, count(*) AS n FROM conversations GROUP BY conv_id) SELECT pos AS pos, CASE WHEN pos + 1 < 3 THEN 'copied' ELSE 'processed' END AS origin, CASE WHEN pos + 1 < 3 THEN n ELSE 5 END AS n FROM c WHERE pos + 1 <= 12 UNION ALL SELECT 12 + k, 'generated', 4 FROM range(5) r(k)")
def entry_files(spark, sf_dir):
    """Lines copied, rewritten and extended under a system message, and new ones behind them."""
    rows = reshape.numbered(message_rows(spark, sf_dir), "conv_id")
    names = spark.createDataFrame([("Ann", 30), ("Bo", 25)], "name string, age int")
    out = generation.processed_file(rows, plugins.ScriptedClient([LONG_ANSWER]), "_pos", 3, 12, 5, system="Be kind.", pairs=1, personas=names)
    return out.select(F.col("_pos").alias("pos"), "origin", F.size("messages").cast("long").alias("n"))


def _pieces(name: str, attempt: int):
    """A stream that refuses at the first attempt for every third row, never closes for every fifth, and goes on for ten turns."""
    k = int(name)
    if k % 3 == 0 and attempt == 0:
        yield "Upon further reflection"
    for turn in range(10):
        yield f"<u>{turn}</u>"
        yield f"<a>{turn}" if k % 5 == 1 else f"<a>{turn}</a>"


@REG.query("streamed_generations")
def streamed_generations(spark, sf_dir):
    seeds = table(spark, sf_dir, "documents").select("doc_id")
    return generation.streamed(seeds, _pieces, "doc_id", {"human": ("<u>", "</u>"), "gpt": ("<a>", "</a>")}, least_turns=2)


# Streams.


def event_files(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "events")
    table(spark, sf_dir, "events").select("event_id", "event_type", "user_id").repartition(4, "event_id").write.parquet(path)
    return path


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema("event_id long, event_type string, user_id long").option("maxFilesPerTrigger", files).parquet(path)


@REG.query("streamed_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_batches(spark, sf_dir):
    """A batch step over each micro-batch, appended."""
    path, target = event_files(spark, sf_dir), new_path(spark, "batches")
    step = lambda batch: batch.groupBy("event_type").agg(F.count("*").alias("n"))
    stream.in_batches(event_stream(spark, path), step, target, new_path(spark, "batches-checkpoint")).awaitTermination()
    return spark.read.parquet(target).groupBy("event_type").agg(F.sum("n").alias("n"))


@REG.query("resumed_events", "SELECT event_id FROM events")
def resumed_events(spark, sf_dir):
    """What an append log lacks is appended to it; together they are all rows, once."""
    log = new_path(spark, "log")
    events = table(spark, sf_dir, "events").select("event_id")
    events.where("event_id % 3 = 0").write.parquet(log)
    todo = stream.resumed(events, spark.read.schema(events.schema).parquet(log), "event_id")
    written(todo, "todo").write.mode("append").parquet(log)
    return spark.read.parquet(log)


@REG.query("stopped_stream", "SELECT event_id FROM events")
def stopped_stream(spark, sf_dir):
    """A stream that is stopped as soon as it has run a batch, and started again: nothing is lost or doubled."""
    path, target, checkpoint = event_files(spark, sf_dir), new_path(spark, "stopped"), new_path(spark, "stopped-checkpoint")
    rows = event_stream(spark, path).select("event_id")
    first = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start(target)
    stream.stop_when(first, lambda: first.lastProgress is not None)
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.parquet(target).select("event_id")


@REG.query("conversation_stream", "WITH n AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT DISTINCT sha256(array_to_string(t, '')) AS sha FROM n")
def conversation_stream(spark, sf_dir):
    """Canonical lines as they arrive, each content once."""
    path, target = new_path(spark, "arriving"), new_path(spark, "once")
    chats = nest(table(spark, sf_dir, "conversations"))
    sinks.write_conversations(chats.union(chats.where("conv_id % 2 = 0")), path)
    seen = stream.first_seen(stream.conversation_stream(spark, path).select("sha"), "sha")
    seen.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "once-checkpoint")).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.parquet(target)



r"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lowering A-Z. A window is `window` consecutive words of an item, or
all words of a shorter one. A document word inside any occurrence of a window is hit.

Each window is the ordered set of its shingles (`shingle` words, or the whole window if shorter). An occurrence holds all of
them, so the prefix to join is one shingle: the rarest in the corpus. Steps:
  1. one scan of the documents makes a row for each word position, in generated code and without a shuffle, and keeps those
     whose shingle hash is one of the benchmark's, with the words around it (written to the shared folder; everything after
     reads only that);
  2. shingle frequencies over all documents order each window's shingles by rarity; windows with a shingle that occurs
     nowhere are done with;
  3. the rarest shingle of each window is joined with the kept positions; start and end must lie in the document (length and
     positional bounds), and the words there must equal the window's.
The benchmark is the stated query set: its hashes and its windows are broadcast in blocks of at most `block_shingles` hashes
(16 bytes each) and `block_windows` windows, one pass for each block, so a benchmark of any size takes the same path in the
same memory, and no position that isn't kept is ever shuffled.

Defined results: null or empty texts have no words and are clean; an item without words has no window; repeated rows each get
a row, repeated items count once by id (a null id counts as the empty string); empty tables give empty results; of further
columns none is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import drop_rows, materialise, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def shingle_at(words: Column, start: Column, size: int) -> Column:
    """The hash of `size` words from the 0-based start."""
    return F.xxhash64(F.lit(size), *(F.get(words, start + k) for k in range(size)))


def in_blocks(table: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The table in parts of about `most` rows, dealt by the hash of a key."""
    n = -(-table.count() // most)
    return [table] if n <= 1 else [table.where(F.pmod(F.xxhash64(F.lit(n), key), F.lit(n)) == k) for k in range(n)]


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """item, words and size of each distinct window."""
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    cut = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
    return cut.distinct().withColumn("size", F.size("words"))


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Each window's shingles with their offsets; k: the words in a shingle."""
    families = []
    for k in range(1, shingle + 1):
        some = windows.where(F.col("size") == k if k < shingle else F.col("size") >= k)
        offsets = F.sequence(F.lit(0), F.greatest(F.col("size") - k, F.lit(0)))
        at = some.select("item", "words", "size", F.lit(k).alias("k"), F.explode(offsets).alias("offset"))
        families.append(at.withColumn("hash", shingle_at(F.col("words"), F.col("offset"), k)))
    out = families[0]
    for x in families[1:]:
        out = out.union(x)
    return out


def scan(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], window: int, wanted: DataFrame) -> DataFrame:
    """row, id, n_words, at, hash, first and around of the positions whose shingle hash is wanted (a broadcast column of
    distinct hashes), and a row at -1 for each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("row", "id", "words", F.size("words").alias("n_words"))
    places = rows.select("row", "id", "words", "n_words", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - min(sizes), F.lit(-1)))).alias("at"))
    hashes = [F.when((F.col("at") >= 0) & (F.col("at") + k <= F.col("n_words")), shingle_at(F.col("words"), F.col("at"), k)) for k in sizes]
    if len(hashes) == 1:
        tried = places.withColumn("hash", hashes[0])
    else:  # shorter shingles too; the document's own row is there once
        tried = places.select("*", F.explode(F.when(F.col("at") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*hashes))).alias("hash"))
    found = tried.join(F.broadcast(wanted.select(F.col("hash").alias("wanted"))), F.col("hash") == F.col("wanted"), "left").where("at < 0 or wanted is not null")
    first = F.greatest(F.col("at") - (window - 1), F.lit(0))
    around = F.when(F.col("at") >= 0, F.slice("words", first + 1, 2 * window - 1))
    return found.select("row", "id", F.col("n_words").cast("long").alias("n_words"), "at", "hash", first.alias("first"), around.alias("around"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 5, share: int = 20, block_shingles: int = 1 << 22, block_windows: int = 100_000) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words) of each document."""
    parts = materialise(window_shingles(benchmark_windows(items, item_col, item_text_col, window), shingle), "windows")
    hashes = materialise(parts.select("hash").distinct(), "hashes")
    sizes = sorted(r.k for r in parts.select("k").distinct().collect()) or [shingle]  # at most `shingle` of them
    passes = [scan(docs, id_col, text_col, sizes, window, block) for block in in_blocks(hashes, "hash", block_shingles)]
    scanned = passes[0]
    for more in passes[1:]:
        scanned = scanned.union(more.where("at >= 0"))
    scanned = materialise(scanned, "hits")
    each = scanned.where("at >= 0").select("row", "n_words", "at", "hash", "first", "around")
    seen = each.groupBy("hash").agg(F.count("*").alias("times"))
    key = ["item", "words", "size"]
    ranked = parts.join(seen, "hash", "left").groupBy(*key).agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "offset", "hash")).alias("rarest"))
    anchors = ranked.where("rarest.times > 0").select(*key, "rarest.offset", "rarest.hash")
    anchors = materialise(anchors.groupBy("words", "size", "offset", "hash").agg(F.collect_set("item").alias("items")), "anchors")
    start = F.col("at") - F.col("offset")
    within = (start >= F.col("first")) & (start + F.col("size") <= F.col("n_words"))
    equal = F.slice("around", F.greatest(start - F.col("first") + 1, F.lit(1)), F.col("size")) == F.col("words")
    occurs = None
    for block in in_blocks(anchors, "words", block_windows):
        some = each.join(F.broadcast(block), "hash").where(within & equal).select("row", start.alias("start"), "size", "items")
        occurs = some if occurs is None else occurs.union(some)
    spans = occurs.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    spans = spans.select("row", F.size(F.array_distinct(covered)).alias("n_hit"), "items")
    rows = scanned.where("at < 0").select("row", "id", "n_words").join(spans, "row", "left")
    return _verdict(rows, id_col, share)


def _verdict(rows: DataFrame, id_col: str, share: int) -> DataFrame:
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns. Texts decide, not ids, which may be null or repeated."""
    texts = docs.select(text_key(text_col).alias("_said"), F.col(text_col).alias("_text"))
    found = contamination(texts, items, "_said", "_text", **options)
    return drop_rows(docs, found.where("contaminated").select("_said"), [text_key(text_col)])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(w, i, i + 12) AS w
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(w) AS n FROM windows),
places AS (
  SELECT r, n, i, list_slice(w, i, i + n - 1) AS w
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occurs AS (SELECT p.r, p.i, p.n, v.item FROM places p JOIN windows v ON p.w = v.w),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM occurs) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occurs) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

"""Queries over documents, pages, embeddings, labels and events: text predicates, n-grams, de-duplication, joins, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions import hashing as H
from dialoom.functions import storage
from dialoom.functions import text as T
from dialoom.functions.turns import nest
from dialoom.operators import dedup, filters, images, joins, ngrams, plugins, recency, repair, reshape, stats, vectors
from dialoom.plans.base import Registry, table
from dialoom.sources import scan, sinks
from dialoom.streaming import dedup as stream

REG = Registry()
UNWANTED = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in T.UNWANTED_RANGES) + "]"


@REG.query("unwanted_unicode", f"SELECT doc_id, regexp_matches(text, '{UNWANTED}') AS unwanted FROM documents")
def unwanted_unicode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_unwanted_unicode("text").alias("unwanted"))


@REG.query("ascii_scrub", r"SELECT doc_id, sha256(regexp_replace(text, '[^\x20-\x7E]', '', 'g')) AS said FROM documents")
def ascii_scrub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.ascii_scrub("text"), 256).alias("said"))


TAGLESS = r"lower(trim(regexp_replace(regexp_replace(html, '(?s)<.*?>', ' ', 'g'), '[\s\pZ\x1C-\x1F\x85]+', ' ', 'g')))"


@REG.query("include_exclude_terms", f"WITH p AS (SELECT page_id, {TAGLESS} AS t FROM pages) SELECT page_id, (contains(t, 'tion') OR contains(t, 'ung der')) AND NOT contains(t, 'the the') AS passes FROM p")
def include_exclude_terms(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", filters.passes_terms("html", ["tion", "Ung  der"], ["The the"]).alias("passes"))


@REG.query("large_images", "SELECT page_id, page_id % 7 * 100 >= 300 AND coalesce(CASE WHEN page_id % 5 > 0 THEN page_id % 5 * 200 END, 0) >= 400 AS passes FROM pages")
def large_images(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", filters.large_enough(F.col("page_id") % 7 * 100, F.when(F.col("page_id") % 5 > 0, F.col("page_id") % 5 * 200), 300, 400).alias("passes"))


@REG.query("url_extensions", r"SELECT page_id, CASE WHEN regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '(\.[a-z0-9]+)$', 1) IN ('.jpg', '.jpeg', '.png', '.webp', '.gif') THEN regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '(\.[a-z0-9]+)$', 1) ELSE '.jpg' END AS ext FROM pages")
def url_extensions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.image_extension("url").alias("ext"))


@REG.query("word_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_'']+|[^\p{L}\p{N}\p{M}_\s\p{Z}\x1C-\x1F\x85]')) AS n FROM documents")
def word_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.word_tokens("text")).cast("long").alias("n"))


@REG.query("sentence_split", r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[\s\pZ\x1C-\x1F\x85]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[\s\pZ]+', '', 'g')) <> '')) AS n FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences("text")).cast("long").alias("n"))


@REG.query("exact_dedup_documents", "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dedup_documents(spark, sf_dir):
    groups = dedup.duplicate_groups(table(spark, sf_dir, "documents"), H.content_key("text"), "doc_id")
    return groups.select(F.col("key").alias("sha"), F.col("keep").alias("doc_id"), "n")


@REG.query("dup_groups_report", "SELECT sha256(text) AS key, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups_report(spark, sf_dir):
    groups = dedup.group_members(table(spark, sf_dir, "documents"), H.content_key("text"), "doc_id")
    return groups.select("key", F.array_join(F.transform("all", lambda x: x.cast("string")), ",").alias("members"))


@REG.query("choose_canonical", "SELECT source, arg_max(doc_id, {'a': doc_id % 10 * (doc_id % 7), 'b': n_chars, 'c': -doc_id}) AS keep FROM documents GROUP BY source")
def choose_canonical(spark, sf_dir):
    return dedup.choose_keep(table(spark, sf_dir, "documents"), "source", "doc_id", F.col("doc_id") % 10 * (F.col("doc_id") % 7), "n_chars", "doc_id")


@REG.query("shingle_sets", "SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(length(text) - 9, 1) + 1), lambda i: substr(text, i, 10)))) AS n FROM documents WHERE length(text) > 0")
def shingle_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.size(H.char_shingles("text")).cast("long").alias("n"))


SIMHASH = """WITH w AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\s\\pZ\\x1C-\\x1F\\x85]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY ALL),
b AS (SELECT doc_id, bit, sum(CASE WHEN (CAST('0x' || substr(md5(word), 17, 4) AS BIGINT) >> bit) & 1 = 1 THEN c ELSE -c END) > 0 AS on_ FROM w, range(16) r(bit) GROUP BY doc_id, bit)
SELECT doc_id, CAST(sum(CASE WHEN on_ THEN 1 << bit ELSE 0 END) AS BIGINT) AS bucket FROM b GROUP BY doc_id"""


@REG.query("simhash_buckets", SIMHASH)
def simhash_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", H.prefix(H.simhash64("text")).alias("bucket"))


PAIRED = "a AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substr(text, i, 3))) AS s FROM benchmark WHERE length(text) > 0)"


@REG.query("exact_jaccard_pairs", f"WITH {PAIRED} SELECT x.item_id AS a, y.item_id AS b FROM a x JOIN a y ON x.item_id < y.item_id WHERE len(list_intersect(x.s, y.s)) >= 0.2 * len(list_distinct(x.s || y.s))")
def exact_jaccard_pairs(spark, sf_dir):
    return dedup.jaccard_pairs(table(spark, sf_dir, "benchmark").select("item_id", H.char_shingles("text", 3).alias("set")), "item_id", "set", 0.2)


@REG.query("minhash_estimates")
def minhash_estimates(spark, sf_dir):
    return dedup.minhash_pairs(table(spark, sf_dir, "benchmark").select("item_id", H.char_shingles("text", 3).alias("set")), "item_id", "set", 0.2)


@REG.query("neardup_dedup")
def neardup_dedup(spark, sf_dir):
    return dedup.near_duplicates(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")


@REG.query("hamming_pairs", "WITH c AS (SELECT doc_id, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS c FROM documents) SELECT x.doc_id AS a, y.doc_id AS b, CAST(bit_count(xor(x.c, y.c)) AS INTEGER) AS d FROM c x JOIN c y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.c, y.c)) <= 5")
def hamming_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long").alias("c"))
    return dedup.hamming_pairs(c, "doc_id", "c", 5, 32)


@REG.query("perceptual_groups")
def perceptual_groups(spark, sf_dir):
    codes = table(spark, sf_dir, "documents").select("doc_id", H.simhash64(F.coalesce("text", F.lit(""))).alias("code"))
    return dedup.perceptual_duplicates(codes, "doc_id", "code")


@REG.query(
    "cosine_topk",
    "WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS a, e.vec_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * e.embedding[i])), 6) AS sim FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), "
    "r AS (SELECT a, b, CAST(row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS INTEGER) AS rank FROM s) SELECT a, b, rank FROM r WHERE rank <= 5",
)
def cosine_topk(spark, sf_dir):
    """Searches: every hundredth vector is a query, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return dedup.searched(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).select("a", "b", "rank")


def doubled(spark, sf_dir) -> DataFrame:
    """Embeddings, and every fifth again with a small change."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    moved = e.where("vec_id % 5 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: (x + F.when(i == 3, 0.05).otherwise(0.0)).cast("float")).alias("embedding"))
    return e.union(moved)


@REG.query("embedding_groups", "SELECT vec_id AS leader, vec_id + 1000000 AS member FROM embeddings WHERE vec_id % 5 = 0")
def embedding_groups(spark, sf_dir):
    return dedup.embedding_groups(doubled(spark, sf_dir), "vec_id", "embedding", 0.97)


@REG.query("text_greedy_dedup", "SELECT vec_id FROM embeddings")
def text_greedy_dedup(spark, sf_dir):
    return dedup.greedy_texts(doubled(spark, sf_dir), "vec_id", "embedding", 0.85).select("vec_id")


@REG.query("multi_method_merge", "WITH a AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS k FROM documents), b AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(trim(text))) AS k FROM documents) SELECT DISTINCT doc_id AS member FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE doc_id <> k")
def multi_method_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")

    def groups(key):
        kept = docs.groupBy(key.alias("k")).agg(F.min("doc_id").alias("keep"))
        return docs.select(F.col("doc_id").alias("member"), key.alias("k")).join(kept, "k").select("member", "keep")

    return dedup.merged_drops([groups(H.content_key("text")), groups(F.sha2(F.lower(F.trim("text")), 256))])


@REG.query("resume_antijoin", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def resume_antijoin(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return joins.not_seen(pages, pages.where("page_id % 3 = 0"), "url").select("page_id")


@REG.query("existing_semijoin", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existing_semijoin(spark, sf_dir):
    return joins.existing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@REG.query("positional_zip", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def positional_zip(spark, sf_dir):
    return joins.zip_by_position(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality")


@REG.query("catalog_full_outer", "WITH a AS (SELECT doc_id AS tensor, source AS listed FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS tensor, CASE WHEN doc_id % 10 = 1 THEN 'moved' ELSE source END AS found FROM documents WHERE doc_id % 4 <> 0) SELECT tensor, coalesce(found, listed) AS file, CASE WHEN found IS NULL THEN 'missing' WHEN listed IS NULL THEN 'unlisted' WHEN found <> listed THEN 'moved' ELSE 'ok' END AS status FROM a FULL JOIN b USING (tensor)")
def catalog_full_outer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tensor"), F.col("source").alias("file"))
    disk = docs.where("tensor % 4 <> 0").withColumn("file", F.when(F.col("tensor") % 10 == 1, "moved").otherwise(F.col("file")))
    return joins.catalog_status(docs.where("tensor % 3 <> 0"), disk)


@REG.query("phrase_containment", "WITH p AS (SELECT DISTINCT string_split(text, ' ')[2] AS phrase FROM benchmark WHERE len(string_split(text, ' ')) > 2) SELECT item_id, phrase FROM benchmark, p WHERE list_contains(list_transform(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w), list_filter(regexp_split_to_array(lower(phrase), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')[1]) AND contains(text, phrase)")
def phrase_containment(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    found = items.where(F.size(F.split("text", " ")) > 2).select(F.get(F.split("text", " "), F.lit(1)).alias("phrase")).distinct()
    return joins.contains_join(items, "text", found, "phrase").select("item_id", "phrase")


@REG.query("subdirectories", "SELECT doc_id, lpad(CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id // 100 END AS VARCHAR), 5, '0') AS folder FROM documents")
def subdirectories(spark, sf_dir):
    path = F.concat(F.lit("images/"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(""), F.col("doc_id").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "documents").select("doc_id", reshape.subdirectory(path, 100).alias("folder"))


@REG.query("unique_names", "WITH b AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, CASE WHEN k = 0 THEN source || '.png' ELSE source || '_' || k || '.png' END AS target FROM b")
def unique_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("lang"), F.lit("/"), "source", F.lit(".png")).alias("path"))
    return reshape.unique_names(rows, "path", "doc_id").select("doc_id", "target")


@REG.query("last_per_name", "SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source")
def last_per_name(spark, sf_dir):
    return reshape.last_per(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@REG.query("criteria_distinct", "SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang")
def criteria_distinct(spark, sf_dir):
    return reshape.ordered_distinct(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")


LISTED_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in ngrams.STOPWORDS)
LISTED_MARKS = ", ".join("'" + p.replace("'", "''") + "'" for p in ngrams.PUNCTUATION)
GRAMS = rf"""WITH t AS (SELECT doc_id AS o, regexp_extract_all(lower(trim(regexp_replace(regexp_replace(translate(text, '‘’`', ''''''''), '[''"]+', '"', 'g'), '[\s\pZ\x1C-\x1F\x85]+', ' ', 'g'))), '[\p{{L}}\p{{N}}\p{{M}}_'']+|[^\p{{L}}\p{{N}}\p{{M}}_\s\p{{Z}}\x1C-\x1F\x85]') AS t FROM documents),
g AS (SELECT o, n, i, t[i:i + n - 1] AS g FROM (SELECT o, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM t, range(3, 6) r(n) WHERE len(t) >= n)),
k AS (SELECT o, n, i, array_to_string(g, ' ') AS ngram FROM g WHERE len(list_filter(g, lambda w: w IN ({LISTED_STOPS}))) <= 1 AND len(list_filter(g, lambda w: w IN ({LISTED_MARKS}))) <= 1),
c AS (SELECT n, ngram, count(*) AS cnt, min(o * 100000 + i) AS pos FROM k GROUP BY n, ngram),
r AS (SELECT n, ngram, cnt, CAST(row_number() OVER (PARTITION BY n ORDER BY cnt DESC, pos) AS INTEGER) AS rank FROM c)
SELECT CAST(n AS INTEGER) AS n, ngram, cnt, rank FROM r WHERE rank <= 10"""


@REG.query("ngram_top10", GRAMS)
def ngram_top10(spark, sf_dir):
    return ngrams.frequent_ngrams(table(spark, sf_dir, "documents"), "doc_id", "text")


@REG.query("ngram_recency")
def ngram_recency(spark, sf_dir):
    return recency.recent_ngrams(table(spark, sf_dir, "documents"), "doc_id", "text")


@REG.query("ngram_jaccard", "WITH w AS (SELECT item_id, item_id + 1 AS next, string_split(text, ' ') AS w FROM benchmark) SELECT a.item_id, round(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(a.w || b.w)), 1), 6) AS j FROM w a JOIN w b ON a.next = b.item_id")
def ngram_jaccard(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    after = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return w.join(after, "item_id").select("item_id", F.round(H.jaccard("w", "v"), 6).alias("j"))


@REG.query("skip_reasons", "SELECT CASE WHEN length(text) < 500 THEN 'short' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def skip_reasons(spark, sf_dir):
    return stats.counters(table(spark, sf_dir, "documents"), F.when(F.length("text") < 500, "short").when(F.col("lang") != "en", "language").otherwise("kept"))


@REG.query("json_fields", "SELECT event_id, coalesce(CAST(props->>'$.prompt' AS VARCHAR), 'none') AS prompt, json_valid(props) AS ok FROM events")
def json_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("_doc", F.try_parse_json("props"))
    return e.select("event_id", F.coalesce(F.try_variant_get("_doc", "$.prompt", "string"), F.lit("none")).alias("prompt"), F.col("_doc").isNotNull().alias("ok"))


META = """WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"file_name":"' || doc_id || '.png","text":"t"}' WHEN 1 THEN '"model": "x", "temperature": 1' WHEN 2 THEN 'plain words' WHEN 3 THEN '{"file_name":"a.png"}' WHEN 4 THEN '[1,2]' ELSE '   ' END AS raw FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'kept' WHEN 1 THEN 'stray_fragment' WHEN 2 THEN 'not_json' WHEN 3 THEN 'missing_field' WHEN 4 THEN 'not_object' ELSE 'blank' END AS reason, CASE doc_id % 6 WHEN 0 THEN doc_id || '.png' WHEN 3 THEN 'a.png' END AS file_name FROM r"""


@REG.query("metadata_salvage", META)
def metadata_salvage(spark, sf_dir):
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, F.concat(F.lit('{"file_name":"'), F.col("doc_id").cast("string"), F.lit('.png","text":"t"}'))).when(k == 1, '"model": "x", "temperature": 1').when(k == 2, "plain words").when(k == 3, '{"file_name":"a.png"}').when(k == 4, "[1,2]").otherwise("   ")
    return scan.metadata(table(spark, sf_dir, "documents").select("doc_id", raw.alias("_raw"))).select("doc_id", "reason", "file_name")


@REG.query("sentence_scores", "WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (1 - quality > 0.6) AS n_positive FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT d.source, coalesce(n, 0) AS n, coalesce(n_positive, 0) AS n_positive, coalesce(n, 0) = 0 OR n_positive / n <= 0.13 AS kept FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN s USING (source)")
def sentence_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    scores = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("source", (1 - F.col("quality")).cast("double").alias("score"))
    return filters.sentence_share(docs.select("source").distinct(), scores, "source", 0.13)


@REG.query("scored_sentences")
def scored_sentences(spark, sf_dir):
    model = plugins.lexicon_scorer(["tion", "the", "erth"])
    rows = plugins.score_sentences(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"), model)
    return filters.sentence_share(table(spark, sf_dir, "benchmark"), rows, "item_id", 0.55)


@REG.query("language_filter")
def language_filter(spark, sf_dir):
    return plugins.english_filter(nest(table(spark, sf_dir, "conversations"))).select("conv_id", "verdict")


@REG.query("tokenize_rows")
def tokenize_rows(spark, sf_dir):
    t = plugins.tokenize(F.col("text"), plugins.hashed_tokenizer())
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.input_ids", "t.attention_mask")


@REG.query("corrected_replies")
def corrected_replies(spark, sf_dir):
    return plugins.corrected(nest(table(spark, sf_dir, "conversations")), plugins.rule_corrector())


@REG.query("improved_messages")
def improved_messages(spark, sf_dir):
    m = nest(table(spark, sf_dir, "conversations")).select("conv_id", repair.to_messages("turns").alias("messages"))
    client = plugins.ScriptedClient(['[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]', "no json"])
    return plugins.improved(m, client).select("conv_id", "improved")


@REG.query("names_distinct", "WITH n(p, k, name, age) AS (VALUES (0, 0, 'Ann', '30'), (0, 1, 'ann', '40'), (0, 2, 'Bo', 'x'), (0, 3, 'Kid', '9'), (1, 0, 'Cy', '18')) SELECT arg_min(name, p * 10 + k) AS name, CAST(arg_min(coalesce(TRY_CAST(age AS INTEGER), 25), p * 10 + k) AS INTEGER) AS age FROM n WHERE coalesce(TRY_CAST(age AS INTEGER), 25) >= 18 GROUP BY lower(name)")
def names_distinct(spark, sf_dir):
    rows = [(0, '```json\n[{"name":"Ann","age":"30"},{"name":"ann","age":"40"},{"name":"Bo","age":"x"},{"name":"Kid","age":"9"}]\n```'), (1, '[{"name":"Cy","age":"18"}]')]
    return plugins.generated_names(spark.createDataFrame(rows, "_pos int, answer string"), "answer")


@REG.query("winsorize", "WITH b AS (SELECT quantile_cont(abs(value), 0.9) AS b FROM events) SELECT event_id, round(greatest(-b, least(b, value)), 6) AS clipped FROM events, b")
def winsorize(spark, sf_dir):
    return vectors.winsorised(table(spark, sf_dir, "events"), "value", 0.9).select("event_id", F.round("clipped", 6).alias("clipped"))


@REG.query("mean_direction", "WITH x AS (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding) AS v FROM embeddings WHERE label IN (0, 1)), m AS (SELECT dim, avg(CAST(v AS DOUBLE)) FILTER (label = 0) - avg(CAST(v AS DOUBLE)) FILTER (label = 1) AS g FROM x GROUP BY dim) SELECT CAST(dim AS INTEGER) AS dim, round(g / (SELECT sqrt(sum(g * g)) FROM m), 6) AS x FROM m")
def mean_direction(spark, sf_dir):
    return vectors.direction(table(spark, sf_dir, "embeddings"), "label", "embedding", 0, 1).select("dim", F.round("x", 6).alias("x"))


@REG.query("null_space_projector")
def null_space_projector(spark, sf_dir):
    return vectors.null_space(table(spark, sf_dir, "embeddings").withColumn("layer", F.lit(0)), "layer", "embedding")


@REG.query("nan_to_null", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events")
def nan_to_null(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return sinks.sanitised(e)


@REG.query("first_seen_stream", "SELECT sha256(text) AS sha FROM documents GROUP BY 1")
def first_seen_stream(spark, sf_dir):
    """The documents as a stream, each content once."""
    path = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(path).schema
    folder = path if not path.endswith(".parquet") else sf_dir
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/documents.parquet*" if folder == sf_dir else folder)
    seen = stream.first_seen(rows.select(H.content_key("text").alias("sha")), "sha")
    target = storage.new_path(spark, "first-seen")
    seen.writeStream.format("parquet").option("checkpointLocation", storage.new_path(spark, "first-seen-checkpoint")).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.parquet(target)


@REG.query("harvest_reasons", f"WITH p AS (SELECT page_id, url, html, page_id % 7 * 100 AS w FROM pages), s AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0), t AS (SELECT *, {TAGLESS} AS t FROM p) SELECT page_id, CASE WHEN url IN (SELECT url FROM s) THEN 'seen' WHEN w < 300 THEN 'too_small' WHEN NOT contains(t, 'tion') THEN 'terms' ELSE 'kept' END AS reason FROM t")
def harvest_reasons(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("width", F.col("page_id") % 7 * 100).withColumn("height", F.col("width"))
    return images.harvest_verdicts(pages, pages.where("page_id % 3 = 0"), ["tion"], [], 300, 300, text="html").select("page_id", "reason")


@REG.query("processed_entries")
def processed_entries(spark, sf_dir):
    m = nest(table(spark, sf_dir, "conversations")).select("conv_id", repair.to_messages("turns").alias("messages"))
    client = plugins.ScriptedClient(['[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]'])
    return plugins.processed(reshape.numbered(m, "conv_id"), client, "_pos", 3, 50, "Be kind.").select("conv_id", "result", "reason")

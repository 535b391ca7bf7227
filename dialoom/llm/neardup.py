"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document's set holds its distinct shingles of `words` words (64-bit hashes; a shorter text is one shingle). Equal sets are
one class, read from the row of its smallest id. Each class gets a sketch of `bins` minima from one permutation; empty bins
borrow from bins chosen by a 2-universal hash of (bin, attempt). Bands of `rows` bins make bucket keys.

Within a bucket only stars are tried: every member against a hub, so candidates grow with the members, not their square.
The hub is the member that shares most buckets with others (in a family of edited copies, the original). Links are confirmed
on full sets. Members of buckets that still hold several components are finished exactly: a prefix-filtered join over their
shingles, ordered from rare to frequent, tries every pair of different components that could reach the threshold. No bucket
is capped.

Defined results: a text without words, or null, has an empty set and is linked with nothing; a row without id is linked with
nothing, has no component and is kept; rows with one id are judged each by its own text; a component is named by its smallest
id; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, drop_rows, join_by_frequency, materialise, mix64, on_texts, sliced, text_key

KNOWN_WORDS = 100_000


class _Words(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


_WORDS = _Words()


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles. Words are runs without ASCII white space, A-Z lowered."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > KNOWN_WORDS:
        _WORDS.clear()
    each = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    size = min(words, len(each))
    total = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        total = (total + each[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(mix64(total))


def key_of(hashes: np.ndarray | bytes) -> bytes:
    """The digest of a set's sorted hashes."""
    return hashlib.blake2b(hashes, digest_size=16).digest()


class Sketcher:
    """One-permutation MinHash with optimal densification."""

    ATTEMPTS = 256

    def __init__(self, bins: int = 128, rows: int = 4) -> None:
        if bins & (bins - 1) or bins % rows:
            raise ValueError("bins is a power of two and a multiple of rows")
        self.bins, self.rows = bins, rows
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        grid = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(self.ATTEMPTS, dtype=np.uint64)
        self.order = (mix64(grid + np.uint64(0x632BE59BD9B4E019)) % np.uint64(bins)).astype(np.int64)
        self.edges = np.arange(bins, dtype=np.uint64) << self.shift
        self.weights = mix64(np.arange(1, bins + 1, dtype=np.uint64)) | np.uint64(1)

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        """The bucket keys of a non-empty set of sorted hashes."""
        at = np.searchsorted(hashes, self.edges)
        low = hashes[np.minimum(at, len(hashes) - 1)]
        full = (at < len(hashes)) & ((low >> self.shift) == np.arange(self.bins, dtype=np.uint64))
        if not full.all():
            empty = np.flatnonzero(~full)
            tries = full[self.order[empty]]
            first = tries.argmax(axis=1)
            lender = self.order[empty, first]
            none = ~tries[np.arange(len(empty)), first]
            if none.any():  # hardly any bin is full: the next full one on the right
                filled = np.flatnonzero(full)
                lender[none] = filled[np.searchsorted(filled, empty[none]) % len(filled)]
            low = low.copy()
            low[empty] = low[lender]
        mixed = mix64(low) * self.weights
        total = mixed.reshape(-1, self.rows).sum(axis=1, dtype=np.uint64)
        return mix64(total + np.arange(len(total), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bins: int = 128, rows: int = 4) -> DataFrame:
    """id, n_shingles, set_key (digest of the set; null when empty), bands and said (digest of the text) of each document."""

    def sketch(batches):
        sketcher = Sketcher(bins, rows)
        for batch in sliced(batches, 1):
            counts, keys, bands = [], [], []
            for text in byte_texts(batch.column(1)):
                own = shingles(text, words)
                counts.append(len(own))
                keys.append(key_of(own) if len(own) else None)
                bands.append(sketcher.bands(own).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column(2)], names=["id", "n_shingles", "set_key", "bands", "said"])

    kind = dict(df.dtypes)[id_col]
    return on_texts(df.select(F.col(id_col), F.col(text_col), text_key(text_col)), sketch, f"id {kind}, n_shingles long, set_key binary, bands array<long>, said binary")


def full_sets(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, the sorted hashes of its set, eight bytes each, and set_key."""

    def make(batches):
        for batch in sliced(batches, 1):
            sets = [shingles(x, words).tobytes() for x in byte_texts(batch.column(1))]
            keys = pa.array(map(key_of, sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), keys], names=["id", "hashes", "set_key"])

    return on_texts(df.select(F.col(id_col), F.col(text_col)), make, f"id {dict(df.dtypes)[id_col]}, hashes binary, set_key binary")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets have 100 * intersection >= percent * union."""
    kind = dict(edges.dtypes)["a"]
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("of_b"))

    def compare(batches):
        for batch in sliced(batches, 2):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return on_texts(edges.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b"), compare, f"a {kind}, b {kind}")


def components(links: DataFrame, tag: str = "labels") -> DataFrame:
    """node and component (the smallest node reachable) for each node of the links (a, b).

    Every round takes the least label among neighbours and then the label of that label, until none changes.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        labels = materialise(labels, tag)
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.least("component", "near").alias("least"), "component")
        onward = labels.select(F.col("node").alias("least"), F.col("component").alias("next"))
        moved = least.join(onward, "least", "left").select("node", F.least("least", F.coalesce("next", "least")).alias("new"), "component")
        moved = materialise(moved, tag)
        labels = moved.select("node", F.col("new").alias("component"))
        if not moved.where("new != component").limit(1).count():
            return labels


def hash_rows(sets: DataFrame) -> DataFrame:
    """rep and hash, a row for each shingle of each set."""
    kind = dict(sets.dtypes)["id"]

    def spread(batches):
        for part in sliced(batches, 1, 1 << 20):
            own = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], names=["rep", "hash"])

    return on_texts(sets.select("id", "hashes"), spread, f"rep {kind}, hash long")


def least_overlap(n: F.Column, m: F.Column, percent: int) -> F.Column:
    """The smallest intersection with which sets of n and m reach the threshold."""
    return F.floor((percent * (n + m) + (99 + percent)) / F.lit(100 + percent))


def rest_by_prefix(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, other): all pairs of different components among the members (rep, n, component, smallest) that could be linked.

    With shingles ordered from rare to frequent, two sets that reach the threshold share one among the first n - overlap + 1
    of each. `smallest` bounds the partner's size. Shingles whose members are of one component join nothing.
    """
    rows = hash_rows(sets.join(members.select(F.col("rep").alias("id")), "id", "left_semi")).distinct()
    rows = materialise(rows, "rest-shingles")
    often = rows.groupBy("hash").agg(F.count("*").alias("df"))
    ordered = rows.join(often, "hash").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("order"))
    prefix = F.col("n") - least_overlap(F.col("n"), F.greatest("smallest", F.ceil(F.col("n") * percent / 100)), percent) + 1
    cut = members.join(ordered, "rep").select("rep", "n", "component", F.posexplode(F.slice("order", 1, F.greatest(prefix, F.lit(1)).cast("int"))).alias("at", "o"))
    cut = materialise(cut.select("rep", "n", "component", "at", F.col("o.hash").alias("hash")), "rest-prefixes")
    mixed = cut.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("hash")
    few = materialise(cut.join(mixed, "hash", "left_semi"), "rest-mixed")
    other = few.select("hash", F.struct("rep", "n", "component", "at").alias("o"))
    overlap = least_overlap(F.col("n"), F.col("o.n"), percent)
    fits = (F.col("rep") < F.col("o.rep")) & (F.col("component") != F.col("o.component")) & (F.col("at") + overlap <= F.col("n")) & (F.col("o.at") + overlap <= F.col("o.n"))
    return few.join(other, "hash").where(fits).select("rep", F.col("o.rep").alias("other"))


def grouped(df: DataFrame, id_col: str, text_col: str, words: int = 5, percent: int = 80, bins: int = 128, rows: int = 4) -> DataFrame:
    """id, said, n_shingles, group, component_id and kept for each row. Groups are components by number, also where ids repeat."""
    docs = materialise(signatures(df, id_col, text_col, words, bins, rows), "signatures")
    classes = docs.where(F.col("set_key").isNotNull() & F.col("id").isNotNull()).groupBy("set_key").agg(F.min(F.struct("id", "n_shingles", "bands")).alias("c"))
    classes = materialise(classes.select("set_key", F.monotonically_increasing_id().alias("rep"), F.col("c.id").alias("first"), F.col("c.n_shingles").alias("n"), F.col("c.bands").alias("bands")), "classes")
    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(keyed.join(shared, "key").select("key", "rep", "n", "size"), "members")
    ranks = materialise(members.groupBy("rep").agg(F.sum("size").alias("rank")), "ranks")
    wanted = materialise(classes.join(ranks, "rep", "left_semi").select("rep", F.col("first").alias("id"), "set_key"), "wanted")
    sets = full_sets(df.where(F.col(id_col).isNotNull()).join(wanted.select(F.col("id").alias(id_col)), id_col, "left_semi"), id_col, text_col, words)
    sets = sets.join(wanted, ["id", "set_key"]).dropDuplicates(["id", "set_key"])
    sets = materialise(sets.select(F.col("rep").alias("id"), "hashes"), "sets")

    # stars: every member against the one that shares most buckets with others
    members = members.join(ranks, "rep")
    hubs = members.groupBy("key").agg(F.min(F.struct((-F.col("rank")).alias("r"), "rep", "n")).alias("hub"))
    near = (F.col("rep") != F.col("hub.rep")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    stars = members.join(hubs, "key").where(near).select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
    links = materialise(confirmed(stars, sets, percent), "links-stars")
    found = materialise(components(links), "found")

    # buckets that still hold several components
    placed = members.select("key", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialise(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("smallest")).where("low != high").select("key", "smallest")
    rest = placed.join(mixed, "key").groupBy("rep").agg(F.min("n").alias("n"), F.min("component").alias("component"), F.min("smallest").alias("smallest"))
    pairs = rest_by_prefix(materialise(rest, "rest"), sets, percent)
    more = materialise(confirmed(pairs.select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct(), sets, percent), "links-rest")
    if more.limit(1).count():
        found = materialise(components(links.union(more)), "found")

    linked = materialise(found.withColumnRenamed("node", "rep").join(classes.select("rep", "first"), "rep"), "linked")
    lowest = materialise(linked.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    named = join_by_frequency(linked, lowest, "component").select("rep", "component", "lowest")
    of_class = classes.join(named, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("group"), F.coalesce("lowest", "first").alias("lowest"))
    out = docs.select("id", "said", "n_shingles", "set_key").join(of_class, "set_key", "left")
    has_id = F.col("id").isNotNull()
    component = F.when(has_id, F.coalesce("lowest", "id"))
    return out.select("id", "said", "n_shingles", F.when(has_id, F.col("group")).alias("group"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_shingles, component_id and kept for each row; see the module's text."""
    return grouped(df, id_col, text_col, **options).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, with all its columns; of rows that are kept and share their id and text, one.

    Rows go by id and text, so that rows with the same id don't take each other along.
    """
    found = materialise(grouped(df, id_col, text_col, **options), "found")
    kept = found.where("kept and id is not null")
    # near copies with one id: the smallest digest stays
    doubled = kept.where("group is not null").groupBy("group").agg(F.min("said").alias("stays"), F.max("said").alias("last")).where("stays != last").select("group", "stays")
    more = kept.join(doubled, "group").where("said != stays")
    keys = [F.col(id_col), text_key(text_col)]
    out = drop_rows(df, found.where("not kept").select("id", "said").union(more.select("id", "said")), keys)
    repeated = kept.groupBy("id", "said").agg(F.count("*").alias("times")).where("times > 1").select(F.col("id").alias("_id"), F.col("said").alias("_said"))
    repeated = materialise(repeated, "repeated")
    if not repeated.limit(1).count():
        return out
    same = [key.eqNullSafe(F.col(name)) for key, name in zip(keys, repeated.columns, strict=True)]
    return out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))

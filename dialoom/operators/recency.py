"""The most frequent n-grams among those that resemble none of the last kept, without moving n-grams.

What is kept depends on all that was kept before, so the texts are one ordered walk. They are sorted and cut into chunks, which
are walked side by side: each starts from what its predecessor's last words alone would have left, and those whose start turns
out to differ from how their predecessor really ended are walked again, until none is left. The first chunk starts from
nothing, so each round settles one more chunk at least, and the result is that of the one walk.
"""

from __future__ import annotations

import hashlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.storage import written
from dialoom.operators.ngrams import PUNCTUATION, STOPWORDS, ranked, tokens

ROWS_TO_PYTHON = "spark.sql.execution.arrow.maxRecordsPerBatch"
BLOCK = 1024
TAIL = 1 << 15  # bytes of a chunk's end that its successor's start is told from at first
MOST_WORDS = 1 << 20
FLUSH = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)

type State = dict[int, list[tuple[bytes, ...]]]  # the last kept of each n


class Vocabulary(dict):
    """Ids of words, in order of appearance, with a hash of each and whether it is a stop word or a mark."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.hashes: list[int] = []
        self.stops: list[bool] = []
        self.marks: list[bool] = []
        self.stop_words = {w.encode() for w in STOPWORDS}
        self.mark_words = {w.encode() for w in PUNCTUATION}

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.words)
        self.words.append(word)
        self.hashes.append(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        self.stops.append(word in self.stop_words)
        self.marks.append(word in self.mark_words)
        return found


def plain_walk(sets: Iterable[frozenset], before: list[frozenset], window: int, threshold: float, equal: bool) -> np.ndarray:
    """Which of the sets are kept; `equal`: only equal sets are alike."""
    last = deque(before, window)
    kept = []
    for s in sets:
        kept.append(s not in last if equal else all(len(s & x) / max(1, len(s | x)) < threshold for x in last))
        if kept[-1]:
            last.append(s)
    return np.array(kept, bool)


def equal_walk(h: np.ndarray, before: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the sets with these hashes are kept, if equal ones are alike, the first `before` being the last kept; and the
    places of those dropped and of what each is dropped for.

    One without an equal before it is kept, and so is one with `window` kept between it and the equal before it. Those few
    that this doesn't decide are walked.
    """
    size = len(h)
    low = np.uint64((1 << max(1, size.bit_length())) - 1)
    key = np.sort((h & ~low) | np.arange(size, dtype=np.uint64))
    place = (key & low).astype(np.int64)
    equal = np.flatnonzero((key[1:] ^ key[:-1]) <= low)
    last = np.full(size, -1, np.int64)
    last[place[equal + 1]] = place[equal]
    kept = last < 0
    kept[:before] = True
    open_ = np.flatnonzero(~kept)
    for _ in range(3):  # what is still open then is walked
        count = np.concatenate([[0], np.cumsum(kept)])
        sure = count[open_] - count[last[open_] + 1] >= window
        kept[open_[sure]] = True
        open_ = open_[~sure]
        if not sure.any() or not len(open_):
            break
    count = np.concatenate([[0], np.cumsum(kept)])
    # of each open one: how many are surely kept before it and before its last equal, and the number of that among the open ones
    at_open = np.searchsorted(open_, last[open_])
    is_open = (at_open < len(open_)) & (open_[np.minimum(at_open, max(0, len(open_) - 1))] == last[open_]) if len(open_) else np.zeros(0, bool)
    ordinal: list[int] = []  # of the kept one by which each open one is judged or which it is, among all kept
    holder: list[int] = []  # its place
    more = [0]  # of the open ones, how many are kept before each
    dropped = []
    rows = zip(open_.tolist(), last[open_].tolist(), count[open_].tolist(), count[last[open_]].tolist(), at_open.tolist(), is_open.tolist(), strict=True)
    for place_, equal_, sure_before, sure_at, own, known in rows:
        now = sure_before + more[-1]
        then, held = (ordinal[own], holder[own]) if known else (sure_at + more[own], equal_)
        fresh = then < now - window
        ordinal.append(now if fresh else then)
        holder.append(place_ if fresh else held)
        more.append(more[-1] + fresh)
        if fresh:
            kept[place_] = True
        else:
            dropped.append(len(holder) - 1)
    return kept, open_[dropped], np.array([holder[k] for k in dropped], np.int64)


class Walk:
    """The walk over chunks of texts, one text a line, its words parted by spaces."""

    def __init__(self, sizes: range, stop_limit: int, punct_limit: int, window: int, threshold: float) -> None:
        self.sizes, self.stop_limit, self.punct_limit, self.window, self.threshold = sizes, stop_limit, punct_limit, window, threshold
        self.vocabulary = Vocabulary()

    def kept(self, text: bytes, start: State) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
        """n, the ids of the first words, second words and so on of what is kept, the places where it begins, and its hashes."""
        if len(self.vocabulary.words) > MOST_WORDS:
            self.vocabulary = Vocabulary()
        known = self.vocabulary
        texts = [x.split(b" ") for x in text.split(b"\n") if x]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        before = {n: np.array([[known[w] for w in g] for g in start.get(n, [])], np.int64).reshape(-1, n) for n in self.sizes}
        hashes = np.array(known.hashes, np.uint64)
        stops, marks = (np.concatenate([[0], np.cumsum(np.array(x, bool)[ids])]) for x in (known.stops, known.marks))
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))
        for n in self.sizes:
            at = np.flatnonzero(left >= n)
            at = at[(stops[at + n] - stops[at] <= self.stop_limit) & (marks[at + n] - marks[at] <= self.punct_limit)]
            columns = [np.concatenate([before[n][:, k], ids[at + k]]) for k in range(n)]
            ordered = np.zeros(len(columns[0]), np.uint64)
            whole = np.zeros(len(columns[0]), np.uint64)
            for k, column in enumerate(columns):
                h = hashes[column] if len(hashes) else np.zeros(0, np.uint64)
                ordered = (ordered ^ (ordered >> np.uint64(29))) * ODD + h
                for other in columns[:k]:
                    h[other == column] = 0
                whole += h
            fresh = self._decided(n, columns, whole, len(before[n]))
            fresh[: len(before[n])] = False
            yield n, [x[fresh] for x in columns], at[fresh[len(before[n]) :]], ordered[fresh]

    def _decided(self, n: int, columns: list[np.ndarray], whole: np.ndarray, before: int) -> np.ndarray:
        # different sets of n words have a likeness of (n - 1) / n at most
        equal = self.threshold > (n - 1) / n
        if equal:
            kept, dropped, by = equal_walk(whole, before, self.window)
            if _same_sets(columns, dropped, by):
                return kept
        sets = [frozenset(x) for x in zip(*(c.tolist() for c in columns), strict=True)]
        return np.concatenate([np.ones(before, bool), plain_walk(sets[before:], sets[:before], self.window, self.threshold, equal)])

    def end(self, start: State, found: dict[int, list[np.ndarray]]) -> State:
        """What is last kept behind a chunk, from what it kept."""
        out = {}
        for n, columns in found.items():
            few = [c[max(0, len(c) - self.window) :].tolist() for c in columns]
            own = [tuple(self.vocabulary.words[w] for w in g) for g in zip(*few, strict=True)]
            both = start.get(n, []) + own
            out[n] = both[max(0, len(both) - self.window) :]
        return out

    def guess(self, text: bytes) -> State:
        """The state behind the text by its last words alone: by as many as keep four windows, or all."""
        size = TAIL
        while True:
            found = {n: columns for n, columns, _, _ in self.kept(text[-size:], {})}
            if size >= len(text) or all(len(c[0]) >= 4 * self.window for c in found.values()):
                return self.end({}, found)
            size *= 4


def _same_sets(columns: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets at a equal those at b: each word of one is among those of the other."""
    one, other = ([c[x] for c in columns] for x in (a, b))
    holds = lambda xs, ys: all(np.logical_or.reduce([x == y for y in ys]).all() for x in xs)
    return holds(one, other) and holds(other, one)


def packed(state: State) -> bytes:
    """A line for each; its number of words is n."""
    return b"\n".join(b" ".join(g) for n in sorted(state) for g in state[n])


def unpacked(lines: bytes) -> State:
    out: State = {}
    for line in lines.split(b"\n") if lines else []:
        g = tuple(line.split(b" "))
        out.setdefault(len(g), []).append(g)
    return out


@contextmanager
def _rows_to_python(spark: SparkSession, rows: int):
    """Batches of this many rows for what is written meanwhile: workers hold a batch as a whole."""
    now = spark.conf.get(ROWS_TO_PYTHON)
    spark.conf.set(ROWS_TO_PYTHON, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_TO_PYTHON, now)


def _chunks(df: DataFrame, order: str, text: str, punctuation: bool, walk: Walk, most_bytes: int) -> DataFrame:
    """part and seq (the order of chunks), text, and the guess of the state behind it. Texts move once, for their order."""
    keyed = df.select(F.col(order).alias("o"), F.col(text).alias("x")).where("x is not null").withColumn("h", F.xxhash64("x"))
    inorder = keyed.repartitionByRange("o", "h").sortWithinPartitions("o", "h", "x")

    def cut(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            whole = b"\n".join(held)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([whole], pa.binary()), pa.array([packed(walk.guess(whole))], pa.binary())], names=["part", "seq", "text", "guess"])

        for batch in batches:
            for line in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(line)
                size += len(line) + 1
                if size >= most_bytes:
                    yield row()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield row()

    with _rows_to_python(df.sparkSession, 500):
        return written(inorder.select(F.array_join(tokens(F.col("x"), punctuation), " ").alias("line")).mapInArrow(cut, "part int, seq int, text binary, guess binary"), "recency-chunks")


def _chunk_rows(batches) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in range(3))


def _bucket_counts(chunks: DataFrame, starts: dict[tuple[int, int], bytes], walk: Walk, buckets: int) -> DataFrame:
    """part, seq and end of each chunk, and block and data of what each task counted by buckets."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(starts)

    def count(batches):
        counts = np.zeros((len(walk.sizes), buckets), np.int64)
        ends = []
        for part, seq, text in _chunk_rows(batches):
            start, found = unpacked(sent.value[part, seq]), {}
            for n, columns, _, hashes in walk.kept(text, start):
                found[n] = columns
                counts[n - walk.sizes[0]] += np.bincount(_bucket(hashes, buckets), minlength=buckets)
            ends.append((part, seq, packed(walk.end(start, found))))
        flat = counts.ravel()
        blocks = [(k // BLOCK, flat[k : k + BLOCK].tobytes()) for k in range(0, len(flat), BLOCK) if flat[k : k + BLOCK].any()]
        rows = [(*x, None, None) for x in ends] + [(None, None, None, *x) for x in blocks]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "seq", "end", "block", "data"])

    with _rows_to_python(spark, 2):
        return written(chunks.select("part", "seq", "text").mapInArrow(count, "part int, seq int, end binary, block int, data binary"), "recency-buckets")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(buckets - 1)).astype(np.int64)


def _summed(parts: DataFrame, walk: Walk, buckets: int) -> np.ndarray:
    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in table.column("data")], axis=0)
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(len(walk.sizes) * buckets, np.int64)
    for r in parts.where("block is not null").select("block", "data").groupBy("block").applyInArrow(add, "block int, data binary").collect():
        own = np.frombuffer(r.data, np.int64)
        out[r.block * BLOCK : r.block * BLOCK + len(own)] = own
    return out.reshape(-1, buckets)


def _counted(chunks: DataFrame, starts: dict[tuple[int, int], bytes], walk: Walk, wanted: np.ndarray) -> DataFrame:
    """n, ngram, cnt and first place of all n-grams of the wanted buckets."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast((starts, np.packbits(wanted, axis=1)))
    buckets = wanted.shape[1]

    def count(batches):
        known, bits = sent.value
        own = np.unpackbits(bits, axis=1, count=buckets).astype(bool)
        counts: Counter[tuple[bytes, ...]] = Counter()
        first: dict[tuple[bytes, ...], tuple[int, int, int]] = {}

        def out():
            keys = list(counts)
            place = [first[g] for g in keys]
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(map(len, keys)), pa.int32()), pa.array([[w.decode() for w in g] for g in keys], pa.list_(pa.string())), pa.array([counts[g] for g in keys], pa.int64()), *(pa.array([p[k] for p in place], pa.int64()) for k in range(3))],
                names=["n", "ngram", "c", "part", "seq", "at"],
            )
            counts.clear()
            first.clear()
            return rows

        for part, seq, text in _chunk_rows(batches):
            for n, columns, at, hashes in walk.kept(text, unpacked(known[part, seq])):
                few = np.flatnonzero(own[n - walk.sizes[0]][_bucket(hashes, buckets)])
                words = walk.vocabulary.words
                for place, *g in zip(at[few].tolist(), *(c[few].tolist() for c in columns), strict=True):
                    key = tuple(words[w] for w in g)
                    counts[key] += 1
                    first[key] = min(first.get(key, (part, seq, place)), (part, seq, place))
                    if len(counts) >= FLUSH:
                        yield out()
        yield out()

    with _rows_to_python(spark, 2):
        parts = chunks.select("part", "seq", "text").mapInArrow(count, "n int, ngram array<string>, c long, part long, seq long, at long")
        return written(parts.groupBy("n", "ngram").agg(F.sum("c").alias("cnt"), F.min(F.struct("part", "seq", "at")).alias("pos")), "recency-counts")


def recent_ngrams(df: DataFrame, order: str, text: str, k: int = 10, least: int = 3, most: int = 5, stop_limit: int = 1, punct_limit: int = 1, punctuation: bool = True, window: int = 50, threshold: float = 0.85, buckets: int = 1 << 18, tried: int = 64, chunk_bytes: int = 1 << 22) -> DataFrame:
    """As top_ngrams(with_recency(ngrams(...))), exactly, by chunks that are walked side by side; only texts move.

    What is kept is counted by buckets first, as in frequent_ngrams; chunks that are walked again count again, so buckets bound
    their n-grams' counts from above. Then the n-grams of the buckets that can hold one of the first k are counted one by one.
    Rows that share a value of `order` follow one another whole, in an order of their texts.
    """
    sizes = range(least, most + 1)
    buckets = max(buckets, BLOCK)
    walk = Walk(sizes, stop_limit, punct_limit, window, threshold)
    chunks = _chunks(df, order, text, punctuation, walk, chunk_bytes)
    spark = df.sparkSession
    guesses = sorted((r.part, r.seq, bytes(r.guess)) for r in chunks.select("part", "seq", "guess").collect())
    names = [(part, seq) for part, seq, _ in guesses]
    after = dict(zip(names, names[1:], strict=False))
    starts = dict(zip(names, [b"", *(x for _, _, x in guesses)], strict=False))
    bound = np.zeros((len(sizes), buckets), np.int64)
    todo, some = starts, chunks
    while todo:
        found = _bucket_counts(some, todo, walk, buckets)
        bound += _summed(found, walk, buckets)
        ends = {(r.part, r.seq): bytes(r.end) for r in found.where("part is not null").select("part", "seq", "end").collect()}
        todo = {after[x]: end for x, end in ends.items() if x in after and starts[after[x]] != end}
        starts = starts | todo
        if todo:
            some = chunks.join(F.broadcast(spark.createDataFrame(list(todo), "part int, seq int")), ["part", "seq"], "left_semi")
    first = np.zeros(bound.shape, bool)
    for own, row in zip(first, bound, strict=True):
        fullest = np.argsort(-row, kind="stable")[:tried]
        own[fullest[row[fullest] > 0]] = True
    counts = _counted(chunks, starts, walk, first)
    others = np.zeros(bound.shape, bool)
    for n in sizes:
        best = [r.cnt for r in counts.where(F.col("n") == n).orderBy(F.desc("cnt")).limit(k).collect()]
        row = n - least
        others[row] = (bound[row] >= (best[-1] if len(best) == k else 1)) & ~first[row]
    if others.any():
        counts = counts.union(_counted(chunks, starts, walk, others))
    return ranked(counts, k)

"""LM scoring: a hashed maximum-entropy model over n-gram and skip features with a class-factored softmax.

Words are the leaves of a tree of nested classes, WIDE to a class, built from their training counts (frequent words lie high).
P(word | history) is the product, down the word's path, of P(child | class, history), each a softmax over a class's children:
the class's own logits, and a weight row for each of three features of the history: the word before (bigram), the two words
before (trigram), and the word two back (skip). So every factor, that of the word itself included, sees all features.
Histories are hashed into rows; each class owns a share of the rows of every feature in proportion to its training tokens.

The words with the highest training counts have leaves of their own; each other word belongs to one of `buckets` leaves by its
hash, and has its smoothed share of the bucket's counts there. Vocabulary, buckets and rows grow with the square root of the
training tokens (sizes_for), up to a bound that keeps a worker's memory in hand; beyond it, buckets hold more words.

Training covers every training token. Counts come first (partial counts in each task, summed by a shuffle). Then come rounds of
full-batch gradient updates: every task sums, for each row and child, the tokens seen and, under the weights of the round
before, the tokens expected; the sums of all tasks differ by the gradient, and each weight takes a damped Newton step,
log((seen + prior) / (expected + prior)), times its feature's rate. At zero weights the expected tokens follow from the counts
alone, so the first round needs no softmax. The later ones (one by default) correct what features say twice; their prior is
stronger, so that they raise the held-out score, too. Expected tokens are summed in whole steps of 2**-12, so a fit doesn't depend on how rows fall into tasks.

Texts become ids a batch at a time: passes over their bytes find the words, one hashed lookup those of the vocabulary, and
the others are hashed all of a length at once, so that no step of Python is taken for a word. Sums of expected tokens go by
pairs of children, whose whole numbers share a float without touching.

Scoring runs over Arrow batches: sparse rows are gathered for thousands of tokens at once. Words outside the vocabulary get
their counts by a shuffled join, so no table of all words is ever held in memory.

Defined results: a null or empty text is the end token alone; a null id is a training row and not held out; repeated rows
each get a row; without training rows all counts are 0 and both scores follow from the formulas; an empty table gives an
empty one; words that tie for the last places of the vocabulary are taken by their hash; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import materialise, mix64, on_texts, shuffle_partitions, sliced

END = b""
BEFORE = 3
WIDE = 16  # children of a class
RATES = (0.7, 0.5, 0.35)  # of the first round, for bigram, trigram and skip rows
LATER = 0.7  # share of these in later rounds
PRIOR = 6.0  # tokens that a row has seen before any
LATER_PRIOR = 600.0  # in later rounds, which would fit rows with few tokens to the training rows alone
STEP = 1 << 12
RARE_CONTEXTS = 1 << 16
LEAST_ROWS = 1 << 16
BATCH = 1 << 12
PART = 1 << 13  # steps whose shares stay in a core's cache
HALF = WIDE // 2
PAIR = 1 << 26  # the place of the second of two sums that share a float, which holds whole numbers below 2**53
OFTEN = PAIR // STEP  # a row seen as often could fill the first place
BLOCK = 1024


def is_held_out(id_col: str, fold: int = 1, folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    """Words without ASCII white space, A-Z lowered, and the end token."""
    found = text.lower().split()
    found.append(END)
    return found


def word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """word and c over all training tokens."""

    def count(batches):
        for texts in gathered(batches, 0, 1 << 23):
            found = split(texts).array().dictionary_encode()
            yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)))], names=["word", "c"])

    return on_texts(train.select(text_col), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Sizes:
    vocabulary: int
    buckets: int  # of all other words
    rows: int  # of a feature


def sizes_for(total: int, most: int = 1 << 20) -> Sizes:
    """Powers of two that grow with the square root of the training tokens; at `most` rows a worker holds 200 MB of weights."""
    power = min(most, 1 << max(8, math.ceil(math.log2(4 * math.sqrt(total + 1)))))
    return Sizes(power, max(16, power >> 8), min(most, max(LEAST_ROWS, 2 * power)))


def word_hash(word: bytes) -> int:
    """Spark's xxhash64 of the bytes, without its sign."""
    return xxhash.xxh64_intdigest(word, 42)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def word_hashes(letters: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """word_hash of the words of `sizes` bytes from `first` on; those below 32 bytes, all of a size at once."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    out = np.empty(len(first), np.uint64)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order])) + 1
    for own in np.split(order, edges) if len(order) else ():
        size = int(sizes[own[0]])
        if size >= 32:
            out[own] = [word_hash(letters[a : a + n].tobytes()) for a, n in zip(first[own].tolist(), sizes[own].tolist(), strict=True)]
            continue
        data = letters[first[own][:, None] + np.arange(size)]
        h = np.full(len(own), 42 + int(five) + size, np.uint64)
        at = 0
        for at in range(8, size + 1, 8):
            lane = np.ascontiguousarray(data[:, at - 8 : at]).view("<u8")[:, 0]
            h = _turned(h ^ (_turned(lane * two, 31) * one), 27) * one + four
        if size - at >= 4:
            lane = np.ascontiguousarray(data[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
            h = _turned(h ^ (lane * one), 23) * two + three
            at += 4
        for k in range(at, size):
            h = _turned(h ^ (data[:, k].astype(np.uint64) * five), 11) * one
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        out[own] = h ^ (h >> np.uint64(32))
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass
class Words:
    """The tokens of some texts, one behind the other, as places in their letters."""

    letters: np.ndarray
    offsets: np.ndarray  # int32, one more than tokens
    sizes: np.ndarray  # tokens of each text

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self.offsets) - 1, [None, pa.py_buffer(self.offsets), pa.py_buffer(self.letters)])

    def ids(self, vocabulary: pa.Array) -> np.ndarray:
        """What _Ids gives for each token."""
        found = pc.index_in(self.array(), value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        other = np.flatnonzero(found < 0)
        first = self.offsets[other].astype(np.int64)
        hashes = word_hashes(self.letters, first, self.offsets[other + 1] - first)
        found[other] = len(vocabulary) + (hashes % np.uint64(RARE_CONTEXTS)).astype(np.int64)
        return found


def split(texts: pa.Array) -> Words:
    """tokens() of every text of a column, null being empty, in a few passes over all of their bytes."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    _, edges, body = texts.buffers()
    edges = np.frombuffer(edges, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges -= edges[0]
    ink = ~SPACE[body]
    cut = np.ones(len(body) + 1, bool)  # is there a bound before this byte?
    np.logical_not(ink, out=cut[1:])
    cut[edges] = True
    begins = np.flatnonzero(ink & cut[:-1])
    cut[:-1] |= ~ink
    ends = np.flatnonzero(ink & cut[1:]) + 1
    words = np.diff(np.searchsorted(begins, edges))
    lengths = np.zeros(len(begins) + len(texts), np.int32)
    lengths[np.arange(len(begins)) + np.repeat(np.arange(len(texts)), words)] = ends - begins
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return Words(LOWER[body[ink]], offsets, words + 1)


def times_in_texts(words: Words, which: np.ndarray) -> pa.Array:
    """For each text, every different word among these tokens and how many of them it is."""
    found = words.array().take(pa.array(which)).dictionary_encode()
    n = max(1, len(found.dictionary))
    text = np.repeat(np.arange(len(words.sizes)), words.sizes)[which]
    pairs, times = np.unique(text * n + found.indices.to_numpy(), return_counts=True)
    rows = pa.StructArray.from_arrays([found.dictionary.take(pa.array(pairs % n)), pa.array(times, pa.int32())], names=["word", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(len(words.sizes) + 1) * n), pa.int32()), rows)


def gathered(batches, column: int, most_bytes: int = 1 << 22):
    """The texts of a column in arrays of about most_bytes."""
    held, size = [], 0
    for batch in sliced(batches, column, most_bytes):
        held.append(batch.column(column).cast(pa.binary()))
        size += held[-1].nbytes
        if size >= most_bytes:
            yield pa.concat_arrays(held)
            held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


class _Ids(dict):
    """Ids of vocabulary words; other words get one of the rare contexts behind them."""

    def __missing__(self, word: bytes) -> int:
        return self.first_rare + word_hash(word) % RARE_CONTEXTS


@dataclass
class Model:
    words: list[bytes]
    counts: np.ndarray  # of each vocabulary word
    bucket_logs: np.ndarray  # log of each bucket's smoothed mass, by which its words' shares are divided
    total: int  # N
    distinct: int  # V
    # the tree: each leaf's steps are steps[leaf] of them from first[leaf]
    first: np.ndarray
    steps: np.ndarray
    node: np.ndarray
    child: np.ndarray
    base: np.ndarray  # (classes, WIDE) log shares
    offset: np.ndarray  # of each class's rows
    mask: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)  # a matrix (rows, WIDE) for each feature

    @property
    def rows(self) -> int:
        return int(self.offset[-1] + self.mask[-1] + 1)

    def ids(self) -> _Ids:
        found = _Ids(zip(self.words, range(len(self.words)), strict=True))
        found.first_rare = len(self.words)
        return found

    def leaves(self, ids: np.ndarray) -> np.ndarray:
        n = len(self.words)
        return np.where(ids < n, ids, n + (ids - n) % len(self.bucket_logs))


def class_tree(masses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first, steps, node, child and base of a tree over the leaves: again and again the WIDE lightest become a class."""
    n = len(masses)
    lacking = -(n - 1) % (WIDE - 1) if n > 1 else WIDE - 1
    heap = [(0.0, -k - 1) for k in range(lacking)] + [(float(m), k) for k, m in enumerate(masses)]
    heapq.heapify(heap)
    above, slot = {}, {}
    bases = []
    made = n
    while not bases or len(heap) > 1:
        own = [heapq.heappop(heap) for _ in range(min(WIDE, len(heap)))]
        mass = sum(m for m, _ in own)
        logs = np.full(WIDE, -60.0)
        for k, (m, name) in enumerate(own):
            above[name], slot[name] = made, k
            if m > 0:
                logs[k] = math.log(m / mass)
        bases.append(logs)
        heapq.heappush(heap, (mass, made))
        made += 1
    root = made - 1
    paths_node, paths_child, first, steps = [], [], [], []
    for leaf in range(n):
        at, own = leaf, []
        while at != root:
            own.append((root - above[at], slot[at]))  # classes are numbered from the root
            at = above[at]
        first.append(len(paths_node))
        steps.append(len(own))
        paths_node += [x for x, _ in reversed(own)]
        paths_child += [x for _, x in reversed(own)]
    return np.array(first, np.int64), np.array(steps, np.int64), np.array(paths_node, np.int32), np.array(paths_child, np.int32), np.array(bases[::-1], np.float32)


def start_model(head: list[tuple[bytes, int]], buckets: list[tuple[int, int]], total: int, distinct: int, rows: int) -> Model:
    """The tree by counts, and no weights. buckets: tokens and distinct words of each."""
    counts = np.array([c for _, c in head], np.int64)
    smoothed = np.array([c + 0.5 * (n + 1) for c, n in buckets])
    masses = np.concatenate([counts.astype(float), smoothed])
    first, steps, node, child, base = class_tree(masses)
    load = np.zeros(len(base))
    np.add.at(load, node, np.repeat(masses, steps))
    share = np.maximum(1, rows * load / load.sum())
    own = (1 << np.floor(np.log2(share)).astype(np.int64)).astype(np.int64)
    return Model([w for w, _ in head], counts, np.log(smoothed), total, distinct, first, steps, node, child, base, np.cumsum(own) - own, own - 1)


def laid_out(texts: list[list[bytes]], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each behind BEFORE starting marks (-1), and the places of real tokens."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return placed(np.fromiter(map(ids.__getitem__, (w for x in texts for w in x)), np.int64, int(sizes.sum())), sizes)


def placed(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As laid_out, from the ids of all tokens and the number of each text."""
    starts = np.cumsum(sizes + BEFORE) - sizes
    out = np.full(int((sizes + BEFORE).sum()), -1, np.int64)
    real = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
    out[real] = ids
    return out, real


def histories(ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A hash of each feature of each token's history: the word before, the two words before, the word two back."""
    one, two = (ids[at - k].astype(np.uint64) for k in (1, 2))
    keys = (one, one * np.uint64(0x9E3779B97F4A7C15) + two, two + np.uint64(1 << 40))
    return [(mix64(x) >> np.uint64(32)).astype(np.int64) for x in keys]


def decisions(model: Model, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The steps down the tree of all tokens at these places: steps of each token, then class, child and the weight row of
    each feature for each step."""
    leaves = model.leaves(ids[at])
    steps = model.steps[leaves]
    place = np.arange(int(steps.sum())) + np.repeat(model.first[leaves] - (np.cumsum(steps) - steps), steps)
    node = model.node[place]
    offset, mask = model.offset[node], model.mask[node]
    return steps, node, model.child[place], [offset + (np.repeat(h, steps) & mask) for h in histories(ids, at)]


def shares(model: Model, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The unnormalised shares of each class's children under the weights; logits stay far from a float's limits."""
    logits = np.take(model.base, node, axis=0, mode="clip")  # all places are there; without clip, take with out copies
    own = np.empty_like(logits)
    for w, r in zip(model.weights, rows, strict=True):
        logits += np.take(w, r, axis=0, out=own, mode="clip")
    return np.exp(logits, out=logits)


def log_probabilities(model: Model, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(leaf | history) of the tokens at these places."""
    out = np.empty(len(at))
    for first in range(0, len(at), BATCH):
        steps, node, child, rows = decisions(model, ids, at[first : first + BATCH])
        p = shares(model, node, rows)
        each = np.log(p[np.arange(len(p)), child] / p.sum(axis=1))
        out[first : first + BATCH] = np.add.reduceat(each.astype(np.float64), np.cumsum(steps) - steps)
    return out


def pair_sums(columns: np.ndarray, r: np.ndarray, n: int, often: bool):
    """The sums of both numbers of each column by r; those of a number that occurs often are added up apart."""
    for column in columns:
        if often:
            second = np.floor(column / PAIR)
            yield np.bincount(r, column - second * PAIR, n), np.bincount(r, second, n)
        else:
            both = np.bincount(r, column, n)
            second = np.floor(both / PAIR)
            yield both - second * PAIR, second


class Tally:
    """Tokens seen and expected by row and child, over the rows of one task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        cells = model.rows * WIDE
        self.seen = [] if model.weights else [np.zeros(cells, np.int64) for _ in RATES]
        self.expected = [np.zeros((WIDE, model.rows)) for _ in RATES] if model.weights else []

    def add(self, ids: np.ndarray, real: np.ndarray) -> None:
        n = self.model.rows
        batch = 32 * BATCH
        for first in range(0, len(real), batch):
            _, node, child, rows = decisions(self.model, ids, real[first : first + batch])
            if not self.expected:
                for seen, r in zip(self.seen, rows, strict=True):
                    np.add.at(seen, r * WIDE + child, 1)
                continue
            columns = np.empty((HALF, len(node)))  # two children share a float
            for at in range(0, len(node), PART):
                part = slice(at, at + PART)
                p = shares(self.model, node[part], [r[part] for r in rows])
                p *= STEP / p.sum(axis=1, keepdims=True)
                np.rint(p, out=p)
                columns[:, part] = (p[:, :HALF] + np.multiply(p[:, HALF:], PAIR, dtype=np.float64)).T
            for expected, r in zip(self.expected, rows, strict=True):
                number = np.bincount(r, minlength=n)
                often = number.max() >= OFTEN
                used = np.flatnonzero(number)
                number[used] = np.arange(len(used))
                for own, sums in enumerate(pair_sums(columns, number[r], len(used), often)):
                    for k, x in zip((own, own + HALF), sums, strict=True):
                        expected[k][used] += x

    def blocks(self):
        """(number, bytes) of the parts that hold anything: what was seen in the first round, then what was expected."""
        number = 0
        for own in [x.T.ravel() for x in self.expected] or self.seen:
            for k in range(0, len(own), BLOCK * WIDE):
                part = own[k : k + BLOCK * WIDE]
                if part.any():
                    yield number, whole_numbers(part)
                number += 1


def whole_numbers(part: np.ndarray) -> bytes:
    """The numbers in four bytes each if they fit, else in eight, behind a mark that says which."""
    kind = "<i4" if part.max() < 1 << 31 else "<i8"
    return kind.encode() + part.astype(kind).tobytes()


def _summed(parts: DataFrame, n: int) -> DataFrame:
    """Add up blocks of floats by number, one at a time. The numbers are whole, so their order makes no difference."""

    def add(batches):
        now, total = None, None
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, data[:3].decode(), offset=3).astype(np.float64)
                if number == now:
                    total += own
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "data"])
                now, total = number, own
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "data"])

    return parts.repartition(n, "block").sortWithinPartitions("block").mapInArrow(add, "block int, data binary")


def tally(train: DataFrame, text_col: str, model: Model) -> list[np.ndarray]:
    """What all tasks have seen (a model without weights) or expect, (rows, WIDE) for each feature.

    Each task sends its tables once, so there are no more tasks than eight for each core.
    """
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        own, vocabulary = Tally(known), pa.array(known.words, pa.binary())
        for texts in gathered(batches, 0):
            words = split(texts)
            own.add(*placed(words.ids(vocabulary), words.sizes))
        for number, data in own.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    few = train.select(text_col).coalesce(8 * spark.sparkContext.defaultParallelism)
    blocks = _summed(on_texts(few, run, "block int, data binary"), min(128, shuffle_partitions(spark)))
    out = [np.zeros(model.rows * WIDE) for _ in RATES]
    each = -(-model.rows * WIDE // (BLOCK * WIDE))
    for row in blocks.collect():  # the model's own size
        k, at = divmod(row.block, each)
        out[k][at * BLOCK * WIDE : (at + 1) * BLOCK * WIDE] = np.frombuffer(row.data, np.float64)
    return [x.reshape(-1, WIDE) for x in out]


def stepped(seen: np.ndarray, expected: np.ndarray, rate: float, tokens: float = PRIOR) -> np.ndarray:
    """The damped Newton step of a feature's weights; the prior has the expected shares."""
    whole = expected.sum(axis=1, keepdims=True)
    prior = tokens * np.divide(expected, whole, out=np.zeros_like(expected), where=whole > 0)
    ratio = np.divide(seen + prior, expected + prior, out=np.ones_like(expected), where=expected + prior > 1e-6)
    return (rate * np.log(np.maximum(ratio, 1e-4))).astype(np.float32)


def updated(model: Model, seen: list[np.ndarray], expected: list[np.ndarray] | None) -> Model:
    """The model after a round. At zero weights each class expects its own shares of what a row has seen."""
    if expected is None:
        of_row = np.repeat(np.arange(len(model.base)), model.mask + 1)
        own = np.exp(model.base.astype(np.float64))[of_row]
        model.weights = [stepped(s, s.sum(axis=1, keepdims=True) * own, rate) for s, rate in zip(seen, RATES, strict=True)]
    else:
        model.weights = [np.clip(w + stepped(s, e, LATER * rate, LATER_PRIOR), -12, 12) for w, s, e, rate in zip(model.weights, seen, expected, RATES, strict=True)]
    return model


def head_words(counts: DataFrame, vocabulary: int) -> DataFrame:
    """word and c of about `vocabulary` words with the highest counts.

    Counts fall into eighths of octaves (500 lines at most, whatever the input); in the last that has words in the
    vocabulary, those with the smallest hashes are taken.
    """
    eighth = F.floor(8 * F.log2(F.col("c").cast("double"))).cast("int")
    sizes = {r.e: r.n for r in counts.groupBy(eighth.alias("e")).agg(F.count("*").alias("n")).collect()}
    left, edge, share = vocabulary, -1, 0.0
    for e in sorted(sizes, reverse=True):
        if sizes[e] > left:
            edge, share = e, left / sizes[e]
            break
        left -= sizes[e]
    few = (eighth == edge) & (F.shiftrightunsigned(F.xxhash64("word"), 33) < int(share * (1 << 31)))
    return counts.where((eighth > edge) | few)


def train_model(train: DataFrame, text_col: str, counts: DataFrame, rounds: int = 2, sizes: Sizes | None = None) -> Model:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    sizes = sizes or sizes_for(total)
    chosen = materialise(head_words(counts, sizes.vocabulary), "head")
    head = sorted(((bytes(r.word), r.c) for r in chosen.collect()), key=lambda x: (-x[1], x[0]))
    bucket = F.xxhash64("word").bitwiseAND(F.lit(sizes.buckets - 1)).cast("int")
    of = {r.b: (r.c, r.n) for r in counts.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    own = {r.b: (r.c, r.n) for r in chosen.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    rest = [tuple(x - y for x, y in zip(of.get(b, (0, 0)), own.get(b, (0, 0)), strict=True)) for b in range(sizes.buckets)]
    model = start_model(head, rest, total, distinct, sizes.rows)
    seen = tally(train, text_col, model)
    model = updated(model, seen, None)
    for _ in range(rounds - 1):
        model = updated(model, seen, [e / STEP for e in tally(train, text_col, model)])
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    train = docs.where(~is_held_out(id_col))
    counts = materialise(word_counts(train, text_col), "word-counts")
    model = train_model(train, text_col, counts, **training)
    sent = spark.sparkContext.broadcast(model)
    whole = math.log10(model.total + 0.5 * (model.distinct + 1))

    def score(batches):
        known = sent.value
        vocabulary = pa.array(known.words, pa.binary())
        n_words = len(known.words)
        base_logs = np.log10(known.counts + 0.5) - whole

        def some(batch):
            words = split(batch.column(1))
            own = words.ids(vocabulary)
            logs = log_probabilities(known, *placed(own, words.sizes))
            inside = own < n_words
            base = np.zeros(len(own))
            if n_words:
                base[inside] = base_logs[own[inside]]
            logs[~inside] -= known.bucket_logs[known.leaves(own[~inside]) - n_words]
            starts = np.cumsum(words.sizes) - words.sizes
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.sizes), pa.array(np.add.reduceat(inside.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts) / math.log(10)), times_in_texts(words, np.flatnonzero(~inside))],
                names=["id", "n_tokens", "n_known", "base", "model", "tail"],
            )

        for batch in sliced(batches, 1):
            yield some(batch)

    kind = dict(docs.dtypes)[id_col]
    scored = on_texts(docs.select(F.col(id_col), F.col(text_col)), score, f"id {kind}, n_tokens long, n_known long, base double, model double, tail array<struct<word:binary,times:int>>")
    scored = materialise(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times").join(counts, "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) * F.col("times")
    tail = tail.groupBy("row").agg(F.sum("times").alias("times"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(log).alias("logs"))
    times, logs = F.coalesce("times", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.drop("tail").join(tail, "row", "left").select(
        F.col("id").alias(id_col), is_held_out("id").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - times * F.lit(whole)).alias("base_score"), (F.col("model") + logs).alias("score"),
    )

"""Quality classifier: histogram gradient-boosted trees over document statistics.

document_statistics(df) computes a fixed vector of statistics of each whole text (no labels, language, source or id among
them). fit_trees() boosts depth-limited trees on binned statistics with logistic loss; the trees are flattened into arrays
(feature, threshold, left child, value) that score() walks for all rows of a batch at once.

quality_scores(docs, labels) fits on at most `sample_rows` labelled rows outside the held-out fold (a documented bound: the
rows with the smallest hash of their id) and scores every document.

Defined results: a null or empty text has statistics of 0 and gets a score like any other; a null id is never a training
row and is not held out; repeated rows each get a row; an empty table gives an empty one; without usable labels, or with
labels of one kind only, every score is the share of label 1 (0.5 without any). Further columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import byte_texts, materialise, on_texts, sliced

STATISTICS = [
    "bytes", "words", "lines", "upper", "digit", "space", "newline", "punctuation", "symbol", "high", "control", "pipe",
    "exclamation", "angle", "bracket", "byte_entropy", "mean_word", "long_words", "distinct_words", "top_word",
    "repeated_neighbour", "symbol_words", "upper_words", "digit_words", "mean_line", "short_lines", "distinct_lines",
    "end_marks", "bullets", "distinct_pairs", "compressed",
]

_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".,;:?'\"-()", b"*#$%&@^~_+=/\\`", bytes(range(128, 256)), bytes(range(9)) + b"\x7f", b"|", b"!", b"<>", b"[]{}"), 1):
    _KIND[list(_bytes)] = _k
_EDGE, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_EDGE[list(b"*#$%&@^~_+=/\\`!|<>[]{}")] = True
_GAP[list(b" \t\n\v\f\r")] = True


def statistics(text: bytes) -> list[float]:
    """The document's statistics, in the order of STATISTICS."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, counts, 13)[1:] / n
    share = counts[counts > 0] / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w, rows = max(1, len(words)), max(1, len(lines))
    seen = Counter(words)
    neighbours = sum(map(operator.eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    gaps = _GAP[raw]
    edge = np.concatenate([gaps[1:], [True]])
    edge[1:] |= gaps[:-1]
    edge[0] = True
    odd = int((edge & _EDGE[raw]).sum())
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *kinds.tolist(), float(-(share * np.log2(share)).sum()),
        int(sizes.sum()) / w, int((sizes > 20).sum()) / w, len(seen) / w, max(seen.values(), default=0) / w,
        neighbours / w, odd / w, sum(map(bytes.isupper, words)) / w, sum(map(bytes.isdigit, words)) / w,
        np.log1p(n / rows), sum(len(x) < 30 for x in lines) / rows, len(set(lines)) / rows,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / rows, sum(x[:2] in (b"- ", b"* ") for x in lines) / rows,
        pairs / w, len(zlib.compress(text, 1)) / n,
    ]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and `stats`, an array of doubles."""

    def compute(batches):
        for batch in sliced(batches, 1):
            rows = [statistics(x) for x in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[id_col, "stats"])

    return on_texts(df.select(F.col(id_col), F.col(text_col)), compute, f"`{id_col}` {dict(df.dtypes)[id_col]}, stats array<double>")


@dataclass
class Trees:
    """All trees in flat arrays: node k tests `feature[k] <= threshold[k]`; children are left[k] and left[k] + 1; leaves
    point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of statistics."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(self.left[at] < 0, at, self.left[at] + right)
            margin += self.value[at]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boost `rounds` trees on histograms of `bins` quantile bins; each level's histograms take one bincount."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        for column, first in ((feature, 0), (threshold, 0.0), (left, -1), (value, 0.0)):
            column.append(first)
        return len(feature) - 1

    if len(y) and 0 < y.sum() < len(y):
        columns = x.shape[1]
        cuts = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) for k in range(columns)]
        binned = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(columns)], axis=1)
        slots = binned + np.arange(columns) * bins
        margin = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            roots.append(node())
            places, at = {roots[-1]: 0}, np.zeros(len(y), np.int64)  # at: the row's place among the open nodes
            ends = np.full(len(y), roots[-1])
            for level in range(depth + 1):
                n = len(places)
                live = at >= 0
                flat = (at[live, None] * (columns * bins) + slots[live]).ravel()
                size = n * columns * bins
                shape = (n, columns, bins)
                gs, hs, cs = (np.bincount(flat, None if w is None else np.repeat(w[live], columns), size).reshape(shape).cumsum(axis=2) for w in (g, h, None))
                opened: dict[int, int] = {}
                moved = np.full(len(y), -1)
                for name, k in places.items():
                    whole_g, whole_h, whole_c = gs[k, 0, -1], hs[k, 0, -1], cs[k, 0, -1]
                    value[name] = rate * whole_g / (whole_h + ridge)
                    if level == depth or whole_c < 2 * least:
                        continue
                    gain = gs[k] ** 2 / (hs[k] + ridge) + (whole_g - gs[k]) ** 2 / (whole_h - hs[k] + ridge) - whole_g**2 / (whole_h + ridge)
                    gain[(cs[k] < least) | (whole_c - cs[k] < least)] = -1
                    best, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[best, cut] <= 1e-9:
                        continue
                    feature[name], threshold[name] = int(best), float(cuts[best][cut])
                    left[name] = node()
                    node()
                    right = binned[:, best] > cut
                    here = at == k
                    for side in (0, 1):
                        opened[left[name] + side] = len(opened)
                        rows = here & (right == bool(side))
                        moved[rows] = opened[left[name] + side]
                        ends[rows] = left[name] + side
                places, at = opened, moved
                if not places:
                    break
            margin += np.array(value)[ends]
    return Trees(np.array(feature or [0]), np.array(threshold or [0.0]), np.array(left or [-1]), np.array(value or [0.0]), np.array(roots, np.int64), depth, base)


def held_out(id_col: str = "doc_id", fold: int = 1, folds: int = 3) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """id and label of the sample_rows ids outside the fold with the smallest hashes."""
    usable = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    return usable.groupBy(id_col).agg(F.max("label").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)


def fit_on(stats: DataFrame, sample: DataFrame, id_col: str, sample_rows: int, **fitting) -> Trees:
    rows = stats.join(F.broadcast(sample), id_col).orderBy(F.xxhash64(id_col), id_col, "stats").limit(sample_rows).collect()
    return fit_trees(np.array([r.stats for r in rows]).reshape(-1, len(STATISTICS)), np.array([r.label for r in rows], float), **fitting)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, **fitting) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; see the module's text."""
    docs = docs.select(id_col, text_col)
    stats = materialise(document_statistics(docs, id_col, text_col), "statistics")
    trees = fit_on(stats, labelled_sample(labels, id_col, label_col, sample_rows), id_col, sample_rows, **fitting)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
                p = model.value.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    scored = stats.mapInArrow(score, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, predicted int")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, **fitting) -> DataFrame:
    """The documents that the same classifier predicts to be of quality 1, with all their columns.

    Only the sample's statistics are gathered; then whole batches of rows are scored and filtered where they lie, so no
    text is shuffled.
    """
    sample = materialise(labelled_sample(labels, id_col, label_col, sample_rows), "sample")
    few = docs.select(id_col, text_col).join(F.broadcast(sample.select(id_col)), id_col, "left_semi")
    trees = fit_on(document_statistics(few, id_col, text_col), sample, id_col, sample_rows, **fitting)
    model = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index(text_col)

    def good(batches):
        for batch in sliced(batches, at):
            x = np.array([statistics(t) for t in byte_texts(batch.column(at))]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.value.score(x) >= 0.5, pa.bool_()))

    return on_texts(docs, good, docs.schema)

"""Packing: token documents cut into pieces, pieces packed first-fit decreasing with a tournament tree of bin capacities,
independently in randomised groups of documents.

token_pieces(df) tokenises whole texts, appends an end id and cuts each document into pieces of at most `length` ids: full
ones and a remainder. pack_pieces(pieces) deals documents, each with all its pieces, by a seeded hash of their row and,
within each partition, packs every run of `group_size` pieces as a group of its own: memory is bounded by the group, and no
group depends on another. A full piece fills a sequence, so only the one remainder of a document competes for bins.
With ids=True the pieces carry the token arrays themselves.

A sequence is padded to `length`, except where its ids already number a power of two.

Defined results: a null or empty text is a document of the end id alone; a null id packs like any other; repeated rows
give repeated pieces, each with a place of its own; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import on_texts, shuffle_partitions, sliced

DEFAULT_VOCABULARY = "byte_bpe_50k"


class Encoder:
    """The ids that `tokenizers` gives whole texts by the tokenizer file, without added special tokens.

    The file says which strings are special tokens; these get their own ids wherever a text holds them. Merges run by the
    same vocabulary's ranks, in a quarter of the library's time; tests hold the ids against the library's.
    """

    def __init__(self, tokenizer_path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        added = Tokenizer.from_file(tokenizer_path or public_tokenizers.path(f"{DEFAULT_VOCABULARY}.json")).get_added_tokens_decoder()
        special = {token.content: number for number, token in added.items()}
        with open(ranks_path or public_tokenizers.path(f"{DEFAULT_VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        known = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: n for k, n in ranks.items() if n not in added}, special_tokens=special)
        self.all_of = functools.partial(known.encode, allowed_special="all", disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.all_of(text), np.uint32)


@functools.cache
def encoder(tokenizer_path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(tokenizer_path, ranks_path)


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, ids: bool = False, tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of each document: document (a number of its row), start, length, ids_crc32, doc_tokens and, if asked for, the
    ids themselves."""
    kind = dict(df.dtypes)[id_col]
    names = [id_col, "document", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] * ids)]

    def cut(batches):
        known = encoder(tokenizer_path, ranks_path)
        for batch in sliced(batches, 2):
            texts = batch.column(2).to_pylist()
            rows: list[int] = []
            numbers: list[tuple[int, int, int, int]] = []
            arrays: list[np.ndarray] = []
            for k, text in enumerate(texts):
                own = np.append(known.encode(text or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(own), length):
                    piece = own[start : start + length]
                    rows.append(k)
                    numbers.append((start, len(piece), zlib.crc32(piece), len(own)))
                    if ids:
                        arrays.append(piece)
            columns = np.array(numbers, np.int64).reshape(-1, 4)
            at = pa.array(rows, pa.int64())
            made = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(columns[:, k]) for k in range(4))]
            if ids:
                made.append(pa.array(arrays, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(made, names=names)

    schema = f"`{id_col}` {kind}, document long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    return on_texts(df.select(F.col(id_col), F.monotonically_increasing_id(), F.col(text_col)), cut, schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item: largest first, each into the first bin with room.

    The bins' free room lies in the leaves of a tournament tree whose inner nodes hold the larger child; the first bin
    with room is found from the root in log2(bins) steps. Ties go to the earlier item.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    width = 1
    while width < len(sizes):
        width *= 2
    free = [capacity] * (2 * width)
    for k in order.tolist():
        size = int(sizes[k])
        at = 1
        while at < width:
            at *= 2
            if free[at] < size:
                at += 1
        bins[k], offsets[k] = at - width, capacity - free[at]
        free[at] -= size
        at //= 2
        while at:
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
            at //= 2
    return bins, offsets


def pack_pieces(pieces: DataFrame, length: int = 1024, group_size: int = 8192, seed: int = 20) -> DataFrame:
    """Add sequence_id and offset. Full pieces are sequences of their own and take no room in the trees."""
    n = shuffle_partitions(pieces.sparkSession)
    dealt = pieces.withColumn("_key", F.xxhash64(F.lit(seed), F.col("document"))).repartition(n, "_key").sortWithinPartitions("_key", "start")
    names = pieces.columns

    def pack(batches):
        base, sequences = TaskContext.get().partitionId() << 40, 0
        held: list[pa.RecordBatch] = []
        rows = 0

        def group(table: pa.Table) -> pa.RecordBatch:
            nonlocal sequences
            sizes = table.column("length").to_numpy()
            full = sizes >= length
            number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            number[full] = np.arange(full.sum())
            rest = np.flatnonzero(~full)
            bins, offset[rest] = first_fit_decreasing(sizes[rest], length)
            number[rest] = bins + full.sum()
            out = table.append_column("sequence_id", pa.array(base + sequences + number)).append_column("offset", pa.array(offset))
            sequences += int(number.max()) + 1
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            held.append(batch.select(names))
            rows += batch.num_rows
            while rows >= group_size:
                table = pa.Table.from_batches(held)
                yield group(table.slice(0, group_size))
                held, rows = table.slice(group_size).to_batches(), rows - group_size
        if rows:
            yield group(pa.Table.from_batches(held))

    kinds = dict(pieces.dtypes)
    return dealt.mapInArrow(pack, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, group_size: int = 8192, seed: int = 20, ids: bool = False) -> DataFrame:
    return pack_pieces(token_pieces(df, id_col, text_col, length, end_id, ids), length, group_size, seed).drop("document")

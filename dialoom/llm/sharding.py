"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Links form stars: documents with one hub are linked through it. By default the hub is the text's digest, so equal texts are
linked. Only groups larger than a shard are cut, into parts of a shard's quota. Rows start at a hashed shard. In each round
every hub finds the shard that holds most of its rows, and asks to go there as a whole; a shard grants requests, large hubs
first, as far as its quota leaves room. Hubs that weren't granted ask again; rounds end when nothing moves. Hot hubs are
joined by broadcasts, so no task holds a group.

The law `rows` then holds exactly (counts differ by one at most): rows of hubs for which no shard has room, with the rows
that have no links, fill what room is left, neighbours side by side. Ranks come from a range partitioning and per-partition
counts; nothing is collected but a line for each shard or group larger than a shard.

Defined results: a null text has 0 bytes and is linked with nothing (empty texts are equal texts); null ids are placed like
others; repeated rows are rows of their own, linked by their text; an empty table gives an empty one; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.llm.common import join_by_frequency, materialise, shuffle_partitions

OVERHEAD = 16


def ranked(df: DataFrame, group: str, order: list[str], tag: str, weight: str | None = None) -> DataFrame:
    """Add `rank`, from 0, of each row in its group (an int column) by the order, without a task for each group.

    With a weight (a long column) it is the sum of the weights before the row.
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    names = [*df.columns, "part", "pos"]
    at = names.index(group)

    def place(batches):
        part, now, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            own = batch.column(at).to_numpy(zero_copy_only=False)
            if not len(own):
                continue
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sizes = np.diff(np.r_[starts, len(own)])
            each = batch.column(names.index(weight)).to_numpy() if weight else np.ones(len(own), np.int64)
            pos = np.cumsum(each) - each
            pos -= np.repeat(pos[starts], sizes)
            if own[0] == now:
                pos[: sizes[0]] += seen
            now, seen = own[-1], int(pos[-1] + each[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(pos.astype(np.int64))], names=names)

    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    placed = materialise(dealt.mapInArrow(place, f"{kinds}, part int, pos long"), tag)
    sizes = placed.groupBy("part", group).agg((F.sum(weight) if weight else F.count("*")).alias("n"))  # partitions + groups rows at most
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), ["part", group]).withColumn("rank", F.col("pos") + F.col("offset")).drop("part", "pos", "offset")


def propagate(linked: DataFrame, quotas: list[int]) -> DataFrame:
    """hub and label of the hubs that got into one shard, of the linked rows (row, hub).

    A hub asks for the shard that holds most of its rows among those with room for all of it, or else for any with room.
    Each shard takes what it is asked for, largest first, up to its room; others ask again until no hub finds room.
    """
    shards = len(quotas)
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("label")
    votes = linked.groupBy("hub", start).agg(F.count("*").alias("n"))  # a line for each hub and shard at most
    hubs = votes.groupBy("hub").agg(F.sum("n").alias("size"), F.collect_list(F.struct("n", "label")).alias("votes"))
    hubs = materialise(hubs.withColumn("less", -F.col("size")), "hubs")
    placed = hubs.limit(0).select("hub", F.lit(0).alias("label"))
    room, most = list(quotas), max(quotas)
    # large hubs first, as small ones find room later too
    for above, upto in [(most // 2, most), (most // 4, most // 2), (most // 16, most // 4), (0, most // 16)]:
        pending = hubs.where((F.col("size") > above) & (F.col("size") <= upto))
        step = 0
        while pending.limit(1).count():
            left = F.array(*map(F.lit, room))
            fits = F.filter("votes", lambda v: F.get(left, v["label"]) >= F.col("size"))
            best = F.array_max(F.transform(fits, lambda v: F.struct(v["n"].alias("n"), (-v["label"]).alias("order"))))
            roomy = F.filter(F.array(*map(F.lit, range(shards))), lambda s: F.get(left, s) >= F.col("size"))
            other = F.get(roomy, F.pmod(F.xxhash64(F.lit(step), "hub"), F.greatest(F.size(roomy), F.lit(1))).cast("int"))
            wish = pending.withColumn("target", F.coalesce(-best["order"], other)).where("target is not null")
            asks = ranked(wish, "target", ["less", "hub"], "wishes", "size")
            asks = materialise(asks.withColumn("goes", F.col("rank") + F.col("size") <= F.get(left, F.col("target"))), "asks")
            for r in asks.where("goes").groupBy("target").agg(F.sum("size").alias("n")).collect():
                room[r.target] -= r.n
            placed = placed.union(asks.where("goes").select("hub", F.col("target").alias("label")))
            pending = asks.where("not goes").select(hubs.columns)
            step += 1
    return materialise(placed, "settled")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """id, size, text_crc32, law ('rows'), shard, slot and grown_shard (null under this law) of each row."""
    text = F.col(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("hub"),
    )
    rows = materialise(rows, "rows")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = materialise(rows.where(F.col("hub").isNotNull()).groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    # groups beyond a shard: `shards` of them at most
    large = [(r.hub, k) for k, r in enumerate(groups.where(F.col("n") > max(quotas)).select("hub").collect())]
    large = F.broadcast(docs.sparkSession.createDataFrame(large, "hub binary, number int"))
    part = F.floor(F.col("rank") / max(1, min(quotas))).cast("string")
    cut = ranked(rows.select("row", "hub").join(large, "hub"), "number", ["row"], "large").select("row", F.concat("hub", F.encode(part, "utf-8")).alias("hub"))
    small = groups.join(large, "hub", "left_anti").select("hub", F.lit(True).alias("linked"))
    linked = join_by_frequency(rows.where(F.col("hub").isNotNull()).select("row", "hub"), materialise(small, "small"), "hub").where("linked").select("row", "hub")
    linked = materialise(cut.union(linked), "linked")
    settled = propagate(linked, quotas)

    first = ranked(join_by_frequency(linked, settled, "hub").where("label is not null"), "label", ["hub", "row"], "kept")
    first = materialise(first, "first")
    full = {r.label: r.n for r in first.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rest = rows.select("row").join(first.select("row"), "row", "left_anti").join(linked, "row", "left")
    rest = ranked(rest.withColumn("label", F.lit(0)), "label", ["hub", "row"], "rest")
    room = np.cumsum([quotas[s] - full.get(s, 0) for s in range(shards)]).tolist()
    ends = F.array(*map(F.lit, room))
    at = F.size(F.filter(ends, lambda e: e <= F.col("rank")))
    taken = F.get(F.array(*(F.lit(full.get(s, 0) - (room[s - 1] if s else 0)) for s in range(shards))), at)
    placed = first.select("row", F.col("label").alias("shard"), F.col("rank").alias("slot")).union(rest.select("row", at.alias("shard"), (F.col("rank") + taken).alias("slot")))
    out = rows.join(placed, "row")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Structured Streaming: de-duplication across files, batch scoring, and resumable appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dialoom.functions.turns import TURNS, values_text


def conversation_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """turns and sha of canonical JSONL as files arrive; malformed and empty lines are skipped."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    turns = F.try_variant_get(F.try_parse_json("value"), "$.conversations", TURNS)
    return raw.select(turns.alias("turns")).where("turns is not null").withColumn("sha", F.sha2(values_text("turns"), 256))


def first_seen(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """One row a key. With an event time, state is bounded by the delay; without, it holds every key ever seen."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def in_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch step to each micro-batch and append it. A batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop_when(query: StreamingQuery, asked: Callable[[], bool], pause: float = 0.2) -> None:
    """Stop a running query once it is asked to; what it has committed stays, and a new start goes on from there."""
    while query.isActive:
        if asked():
            query.stop()
            return
        query.awaitTermination(pause)


def resumed(todo: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """What the append log doesn't hold yet."""
    return todo.join(log.select(key).distinct(), key, "left_anti")

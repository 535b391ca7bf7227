"""Generated conversations and captions: each operator asks a plug-in client in batches and judges the answers in SQL."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dialoom.functions import text as T
from dialoom.functions.storage import written
from dialoom.operators.filters import FORCED_RETRIES, REFUSALS, generation_verdict
from dialoom.operators.plugins import LLMClient, extended, generated, improved, prompt_queue, retried
from dialoom.operators.repair import CLOSING, MESSAGES, fix, json_array, to_turns, why_invalid, with_system


class ImageCaptioner(Protocol):
    def __call__(self, image: bytes, prompt: str, temperature: float) -> str: ...


def sized_captioner(image: bytes, prompt: str, temperature: float) -> str:
    """An offline caption: the prompt, the image's size and a short digest."""
    return f"{prompt.strip()} ({len(image)} bytes, {hashlib.sha256(image).hexdigest()[:8]})"


def answered(df: DataFrame, prompt: Column, client: LLMClient, name: str) -> DataFrame:
    """Add the JSON array of the client's answer as messages; null where it has none. Answers are written down, so that no
    row is asked twice."""
    return written(df.withColumn(name, json_array(generated(df, prompt, client))), "answers").withColumn(name, F.from_json(name, MESSAGES))


def improved_or_extended(df: DataFrame, client: LLMClient, pairs: int, messages_col: str = "messages") -> DataFrame:
    """Add `combined`: the client's improved and extended conversation, repaired; where that can't be read, the improved one
    extended; null if neither works. Without pairs, improvement alone."""
    if pairs <= 0:
        return improved(df, client, messages_col).withColumnRenamed("improved", "combined")
    asked = answered(df, F.concat(F.lit(f"improve and add {pairs}: "), F.to_json(messages_col)), client, "_once").withColumn("_once", fix("_once"))
    once = written(improved(asked, client, messages_col), "improved")
    twice = written(extended(once, client, pairs, "improved"), "extended")
    return twice.withColumn("combined", F.coalesce("_once", F.when(F.col("improved").isNotNull(), F.col("extended")))).drop("_once", "improved", "extended")


def new_conversations(seeds: DataFrame, client: LLMClient, examples_col: str | None = None, most: int = 3) -> DataFrame:
    """Add `turns`: a new conversation for each row, from at most `most` examples (an array of JSON texts), repaired; null where
    the answer can't be read or repaired."""
    shown = F.lit("") if examples_col is None else F.coalesce(F.concat(F.lit("Examples:\n"), F.array_join(F.slice(examples_col, 1, most), "\n---\n"), F.lit("\n\n")), F.lit(""))
    prompt = F.concat(shown, F.lit("Generate a new conversation as a JSON array of role and content. Row "), F.to_json(F.struct(*(c for c in seeds.columns if c != examples_col))))
    made = answered(seeds, prompt, client, "_m").withColumn("_m", fix("_m"))
    return made.withColumn("turns", F.when(F.col("_m").isNotNull(), to_turns("_m"))).drop("_m")


def single_reply(df: DataFrame, client: LLMClient, messages_col: str = "messages") -> DataFrame:
    """Add `reply`: one answer to a conversation, or the stock one where the client says nothing."""
    said = T.strip(generated(df, F.to_json(messages_col), client))
    return df.withColumn("reply", F.when(F.coalesce(said, F.lit("")) == "", CLOSING).otherwise(said))


def drawn(key: Sequence[Column | str], low: float, high: float, seed: int = 0, digits: int | None = None) -> Column:
    """A number between low and high by the hash of a key: the same on every run and whatever the partitions."""
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") / float(1 << 53)
    out = low + (high - low) * share
    return out if digits is None else F.round(out, digits)


def entries(df: DataFrame, client: LLMClient, key: str, system: str | None = None, rewrite: bool = True, pairs: int = 0, personas: DataFrame | None = None, seed: int = 0, messages_col: str = "messages") -> DataFrame:
    """Add temperature (drawn from 0.69 to 1.42), persona and `result`: rewritten and extended as asked, with the system message,
    null where the answer fails or isn't valid. Personas (name, age; a short list) are drawn by the key."""
    out = df.withColumn("temperature", drawn([key], 0.69, 1.42, seed))
    persona = F.lit(None).cast("string")
    if personas is not None:
        each = F.array(*(F.lit(f"{r['name']} (age {r['age']})") for r in personas.orderBy("name").collect()))  # a list of names
        persona = F.get(each, F.pmod(F.xxhash64(F.lit(seed + 1), key), F.greatest(F.size(each), F.lit(1))).cast("int"))
    out = out.withColumn("persona", persona)
    if rewrite:
        out = improved_or_extended(out, client, pairs, messages_col)
    elif pairs > 0:
        out = extended(out, client, pairs, messages_col).withColumnRenamed("extended", "combined")
    else:
        out = out.withColumn("combined", F.col(messages_col))
    made = F.col("combined")
    if system is not None:
        said = F.concat(F.lit(system), F.coalesce(F.concat(F.lit("\n\nRoleplay: You are conversing with "), "persona", F.lit(". Address them by name naturally.")), F.lit("")))
        made = F.when(F.col("combined").isNotNull(), with_system("combined", said))
    out = out.withColumn("_made", made)
    out = written(out, "entries")
    return out.withColumn("result", F.when(F.col("_made").isNotNull() & why_invalid("_made").isNull(), F.col("_made"))).drop("combined", "_made")


def processed_file(df: DataFrame, client: LLMClient, pos: str, first: int, last: int, new: int = 0, **asked) -> DataFrame:
    """pos, messages and `origin`: lines before `first` copied, up to `last` processed (failed ones go), later ones dropped, and
    `new` generated conversations behind them."""
    kept = df.where(F.col(pos) + 1 < first).select(pos, F.col("messages"), F.lit("copied").alias("origin"))
    done = entries(df.where((F.col(pos) + 1 >= first) & (F.col(pos) + 1 <= last)), client, pos, **asked)
    out = kept.union(done.where("result is not null").select(pos, F.col("result").alias("messages"), F.lit("processed").alias("origin")))
    if new > 0:
        made = new_conversations(df.sparkSession.range(new).select((F.col("id") + last).alias(pos)), client)
        back = F.transform("turns", lambda t: F.struct(F.when(t["from"] == "human", "user").when(t["from"] == "gpt", "assistant").otherwise(t["from"]).alias("role"), t["value"].alias("content")))
        out = out.union(made.where("turns is not null").select(pos, back.alias("messages"), F.lit("generated").alias("origin")))
    return out


def streamed(seeds: DataFrame, chunks: Callable[[str, int], Iterator[str]], key: str, tags: dict[str, tuple[str, str]], least_turns: int = 3, stop_share: float = 0.25, attempts: int = 3, seed: int = 0, refusals: Sequence[str] = REFUSALS, retries: Sequence[str] = FORCED_RETRIES) -> DataFrame:
    """Add `said` and `outcome` of a streamed generation for each row; chunks(key, attempt) yields its pieces.

    After each closing assistant tag, once `least_turns` are said, the stream ends with a chance of `stop_share` (drawn by the
    key). A refusal or a banned phrase abandons the attempt; the next one starts anew. A stream that ends by itself is kept if
    it holds a closing tag of each side, else it is `incomplete`; after all attempts failed the row is `abandoned`.
    """
    closing = tags["gpt"][1]
    user_closing = tags["human"][1]
    banned = [*refusals, *retries]

    def one(name: str) -> tuple[str | None, str]:
        for attempt in range(attempts):
            rng = random.Random(f"{seed}:{name}:{attempt}")
            said, turns, failed = "", 0, False
            for piece in chunks(name, attempt):
                said += piece
                if any(x in said for x in banned):
                    failed = True
                    break
                if said.endswith(closing):
                    turns += 1
                    if turns >= least_turns and rng.random() < stop_share:
                        return said, "stopped"
            if failed:
                continue
            if closing in said and user_closing in said:
                return said, "ended"
            return None, "incomplete"
        return None, "abandoned"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([one(str(k)) for k in x], columns=["said", "outcome"])

    made = seeds.withColumn("_s", F.pandas_udf(run, "said string, outcome string")(F.col(key).cast("string")))
    return made.withColumn("said", F.col("_s.said")).withColumn("outcome", F.col("_s.outcome")).drop("_s")


def captioned(images: DataFrame, captioner: ImageCaptioner, prompts: Sequence[str], done: DataFrame | None = None, key: str = "path", seed: int = 0, low: float = 0.5, high: float = 1.0) -> DataFrame:
    """key, index, prompt, temperature and caption of the images that `done` lacks.

    Indices go on behind those that are done, along the key. Prompts come from a queue that is shuffled, used up and filled
    again, 64 rounds of it, after which it starts over; temperatures are drawn by the key, to two digits.
    """
    from dialoom.operators.reshape import numbered

    todo, start = images, 0
    if done is not None:
        todo = images.join(done.select(key), key, "left_anti")
        start = (done.agg(F.max("index")).first()[0] or 0) + 1 if done.limit(1).count() else 0
    queue = F.array(*map(F.lit, prompt_queue(prompts, 64 * len(prompts), seed)))
    ranked = numbered(todo, key).withColumn("index", F.col("_pos") + start).drop("_pos")
    asked = ranked.withColumn("prompt", F.get(queue, F.pmod("index", F.size(queue)).cast("int"))).withColumn("temperature", drawn([key], low, high, seed, 2))

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for content, prompt, heat in batches:
            yield pd.Series([retried(lambda c=c, p=p, t=t: captioner(bytes(c), p, t)) for c, p, t in zip(content, prompt, heat, strict=True)])

    return asked.withColumn("caption", F.pandas_udf(run, StringType())("content", "prompt", "temperature")).select(key, "index", "prompt", "temperature", "caption")


def known_caption(df: DataFrame) -> Column:
    """The first of text, caption and description that says anything, stripped; else an empty text."""
    there = [c for c in ("text", "caption", "description") if c in df.columns]
    return F.coalesce(*(F.nullif(T.strip(F.col(c).cast("string")), F.lit("")) for c in there), F.lit(""))


def extracted_images(df: DataFrame, pos: str, content: str = "content", cached: DataFrame | None = None) -> DataFrame:
    """file_name (image_000000.png, ... along pos), content, caption and `fresh`: whether the cache lacks the file."""
    name = F.format_string("image_%06d.png", F.col(pos))
    out = df.select(name.alias("file_name"), F.col(content).alias("content"), known_caption(df).alias("caption")).where(F.col("content").isNotNull())
    if cached is None:
        return out.withColumn("fresh", F.lit(True))
    there = cached.select("file_name").distinct().withColumn("_there", F.lit(True))
    return out.join(there, "file_name", "left").withColumn("fresh", F.col("_there").isNull()).drop("_there")


def verdicts(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("verdict", generation_verdict(text))

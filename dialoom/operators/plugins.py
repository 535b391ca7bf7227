"""Pluggable models with deterministic offline defaults, and the operators that call them."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from dialoom.functions import text as T
from dialoom.functions.turns import of_role


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class LanguageId(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[tuple[str, float]]: ...


class SentenceScorer(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[float]: ...


class Tokenizer(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[int]]: ...


class LLMClient(Protocol):
    def chat_completion(self, model: str, system: str, user: str, temperature: float, max_tokens: int) -> str: ...


def hashed_embedder(dims: int = 64, n: int = 3) -> Embedder:
    """Unit vectors of hashed character n-grams."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims), np.float32)
        for k, x in enumerate(texts):
            x = f" {' '.join((x or '').lower().split())} "
            for i in range(len(x) - n + 1):
                h = int.from_bytes(hashlib.blake2b(x[i : i + n].encode(), digest_size=4).digest(), "big")
                out[k, h % dims] += 1 if h >> 31 else -1
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out.tolist()

    return embed


# Frequent words of each language.
FREQUENT = {
    "en": "the of and to in is was that for with this on are by be it at from".split(),
    "de": "der die das und ist nicht ein eine zu den mit sich auf für von im dem auch".split(),
    "fr": "le la les de des et est un une du que en pour dans au par sur avec".split(),
    "es": "el la los las de que y en un una es por con para no se del su".split(),
}


def frequent_word_language(texts: Sequence[str]) -> list[tuple[str, float]]:
    """The language with most frequent words, and its share of all that were found."""
    sets = {k: frozenset(v) for k, v in FREQUENT.items()}
    out = []
    for x in texts:
        words = [w.strip(".,;:!?\"'()").lower() for w in (x or "").split()]
        hits = {k: sum(w in s for w in words) for k, s in sets.items()}
        best = max(hits, key=lambda k: (hits[k], k))
        out.append((best, hits[best] / sum(hits.values())) if sum(hits.values()) else ("und", 0.0))
    return out


def lexicon_scorer(words: Sequence[str]) -> SentenceScorer:
    """0.5 plus what share of a sentence's words, four times over, is in the lexicon; 1 at most."""
    known = frozenset(w.lower() for w in words)

    def score(texts: Sequence[str]) -> list[float]:
        out = []
        for x in texts:
            own = [w.strip(".,;:!?\"'()").lower() for w in (x or "").split()]
            out.append(min(1.0, 0.5 + 2.0 * sum(w in known for w in own) / max(1, len(own))) if any(w in known for w in own) else 0.0)
        return out

    return score


def hashed_tokenizer(size: int = 32_000) -> Tokenizer:
    """Ids of lower-case words and marks, by hash."""
    import re

    cut = re.compile(r"[\w']+|[^\w\s]")
    return lambda texts: [[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big") % size for w in cut.findall((x or "").lower())] for x in texts]


def rule_corrector(rules: dict[str, str] | None = None) -> Callable[[Sequence[str]], list[str]]:
    table = rules or {" ,": ",", " .": ".", "  ": " "}

    def correct(texts: Sequence[str]) -> list[str]:
        out = []
        for x in texts:
            for a, b in table.items():
                x = x.replace(a, b)
            out.append(x.strip())
        return out

    return correct


class ScriptedClient:
    """Answers from a list, by the hash of what it is asked."""

    def __init__(self, answers: Sequence[str]) -> None:
        self.answers = list(answers)

    def chat_completion(self, model: str, system: str, user: str, temperature: float = 1.0, max_tokens: int = 4096) -> str:
        key = hashlib.sha256(f"{model}\n{system}\n{user}".encode()).digest()
        return self.answers[int.from_bytes(key[:4], "big") % len(self.answers)]


def retried(call: Callable[[], str], attempts: int = 5, first: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] | None = None) -> str:
    """Call again after failures, with growing pauses and jitter."""
    import time

    pause = first
    for k in range(attempts):
        try:
            return call()
        except (TimeoutError, ConnectionError):
            if k == attempts - 1:
                raise
            (sleep or time.sleep)(min(most, pause) * random.uniform(0.5, 1.5))
            pause *= 2
    raise AssertionError


def embed(texts: Column, model: Embedder) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(model(x.fillna("").tolist())))

    return F.pandas_udf(run, ArrayType(FloatType()))(texts)


def identify(texts: Column, model: LanguageId = frequent_word_language) -> Column:
    """struct<label, prob>."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame(model(x.fillna("").tolist()), columns=["label", "prob"])

    return F.pandas_udf(run, StructType([StructField("label", StringType()), StructField("prob", DoubleType())]))(texts)


def tokenize(texts: Column, model: Tokenizer) -> Column:
    """struct<input_ids, attention_mask>."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([list(y) for y in model(x.fillna("").tolist())])

    ids = F.pandas_udf(run, ArrayType(IntegerType()))(texts)
    return F.transform(F.array(ids), lambda i: F.struct(i.alias("input_ids"), F.transform(i, lambda _: F.lit(1)).alias("attention_mask")))[0]


def corrected(df: DataFrame, model: Callable[[Sequence[str]], Sequence[str]], turns_col: str = "turns") -> DataFrame:
    """Replies through a grammar corrector; other turns stay."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for turns in rows:
                at = [k for k, t in enumerate(turns) if t["from"] == "gpt" and t["value"] is not None]
                fixed = dict(zip(at, model([turns[k]["value"] for k in at]), strict=True))
                out.append([{"from": t["from"], "value": fixed.get(k, t["value"])} for k, t in enumerate(turns)])
            yield pd.Series(out)

    kind = ArrayType(StructType([StructField("from", StringType()), StructField("value", StringType())]))
    return df.withColumn(turns_col, F.pandas_udf(run, kind)(turns_col))


def english_filter(df: DataFrame, model: LanguageId = frequent_word_language, threshold: float = 0.69, turns_col: str = "turns") -> DataFrame:
    """Add `verdict`: kept where the replies are English by the model and hold no unwanted letters."""
    said = F.regexp_replace(F.array_join(F.transform(of_role("gpt", turns_col), lambda t: t["value"]), " "), "\n", " ")
    judged = df.withColumn("_said", said).withColumn("_l", identify(F.col("_said"), model))
    kept = (F.col("_l.label") == "en") & (F.col("_l.prob") >= threshold) & ~T.has_unwanted_unicode("_said")
    return judged.withColumn("verdict", F.when(kept, "kept").otherwise("rejected")).drop("_said", "_l")


def score_sentences(df: DataFrame, id_col: str, text: Column, model: SentenceScorer) -> DataFrame:
    """id, sentence and score. Each distinct sentence is scored once and joined back."""
    each = df.select(id_col, F.explode(T.sentences(text)).alias("sentence"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model(x.tolist()), dtype=float)

    scored = each.select("sentence").distinct().withColumn("score", F.pandas_udf(run, DoubleType())("sentence"))
    return each.join(scored, "sentence")


def generated(df: DataFrame, prompt: Column, client: LLMClient, model: str = "offline", system: str = "", temperature: float = 1.0, max_tokens: int = 4096) -> Column:
    """The client's answer to each prompt."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([retried(lambda p=p: client.chat_completion(model, system, p, temperature, max_tokens)) for p in x.fillna("")])

    return F.pandas_udf(run, StringType())(prompt)


def improved(df: DataFrame, client: LLMClient, messages_col: str = "messages") -> DataFrame:
    """Add `improved`: the client's rewrite as fixed messages, null unless it has as many messages."""
    from dialoom.operators.repair import MESSAGES, fix, json_array

    asked = df.withColumn("_a", json_array(generated(df, F.to_json(messages_col), client)))
    made = fix(F.from_json("_a", MESSAGES))
    return asked.withColumn("improved", F.when(F.size(F.from_json("_a", MESSAGES)) == F.size(messages_col), made)).drop("_a")


def extended(df: DataFrame, client: LLMClient, pairs: int, messages_col: str = "messages") -> DataFrame:
    """Add `extended`: the messages and exactly 2 * pairs new ones that end with the assistant, else null."""
    from dialoom.operators.repair import MESSAGES, fix, json_array

    asked = df.withColumn("_a", F.from_json(json_array(generated(df, F.to_json(messages_col), client)), MESSAGES))
    good = (F.size("_a") == 2 * pairs) & (F.element_at("_a", -1)["role"] == "assistant")
    return asked.withColumn("extended", F.when(good, fix(F.concat(messages_col, "_a")))).drop("_a")


def generated_names(answers: DataFrame, column: str) -> DataFrame:
    """name and age of JSON answers: distinct whatever the case (first wins), ages that aren't numbers become 25, adults only."""
    from dialoom.operators.repair import json_array

    kind = "array<struct<name:string,age:string>>"
    each = answers.select("_pos", F.posexplode(F.from_json(json_array(F.col(column)), kind)).alias("k", "n"))
    age = F.coalesce(F.expr("try_cast(n.age as int)"), F.lit(25))
    rows = each.select("_pos", "k", T.strip(F.col("n.name")).alias("name"), age.alias("age")).where("name <> '' and age >= 18")
    return rows.groupBy(F.lower("name").alias("_l")).agg(F.min_by(F.struct("name", "age"), F.struct("_pos", "k")).alias("r")).select("r.*")


def json_dump(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def prompt_queue(prompts: Sequence[str], count: int, seed: int) -> list[str]:
    """A shuffled queue without replacement that is filled again when empty."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        out += rng.sample(list(prompts), len(prompts))
    return out[:count]


def processed(df: DataFrame, client: LLMClient, pos: str, first: int, last: int, system: str | None = None, messages_col: str = "messages") -> DataFrame:
    """Lines before `first` as they are, those up to `last` improved, those behind gone. Add `result` and `reason`: null, or why
    the improved messages were rejected (the line then keeps its own)."""
    from dialoom.operators.repair import why_invalid, with_system
    from dialoom.operators.reshape import line_range

    made = improved(line_range(df, pos, first, last), client, messages_col)
    new = F.col("improved") if system is None else F.when(F.col("improved").isNotNull(), with_system("improved", system))
    out = made.withColumn("_new", new).withColumn("reason", F.when(F.col("processed"), F.when(F.col("_new").isNull(), "no answer").otherwise(why_invalid("_new"))))
    return out.withColumn("result", F.when(F.col("processed") & F.col("reason").isNull(), F.col("_new")).otherwise(F.col(messages_col))).drop("_new", "improved", "processed")

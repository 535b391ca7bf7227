"""Conversation filters. Each adds a verdict or keeps rows; none runs an action."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.functions.text import col
from dialoom.functions.turns import of_role, values_text


def neighbours(turns: Column, test) -> Column:
    """Some adjacent pair of turns passes test(first, second)."""
    at = F.sequence(F.lit(0), F.greatest(F.size(turns) - 2, F.lit(0)))
    return (F.size(turns) > 1) & F.exists(at, lambda i: F.coalesce(test(F.get(turns, i), F.get(turns, i + 1)), F.lit(False)))


def has_blank_turn(turns: Column | str = "turns") -> Column:
    """A turn that isn't the system's says nothing."""
    return F.exists(col(turns), lambda t: (F.coalesce(t["from"], F.lit("")) != "system") & T.is_blank(t["value"]))


def has_open_ending(turns: Column | str = "turns") -> Column:
    return F.exists(col(turns), lambda t: T.ends_open(t["value"]))


def has_null_reply(turns: Column | str = "turns") -> Column:
    return F.exists(col(turns), lambda t: (F.coalesce(t["from"], F.lit("")) == "gpt") & t["value"].isNull())


def has_empty_system(turns: Column | str = "turns") -> Column:
    return F.exists(col(turns), lambda t: (F.coalesce(t["from"], F.lit("")) == "system") & T.is_blank(t["value"]))


def without_repeated_system(turns: Column | str = "turns") -> Column:
    """System turns that say what the next human turn says are taken out."""
    x = col(turns)
    low = lambda t: F.lower(T.strip(t["value"]))
    repeats = lambda t, i: F.coalesce((t["from"] == "system") & (F.get(x, i + 1)["from"] == "human") & (low(t) == low(F.get(x, i + 1))), F.lit(False))
    return F.filter(x, lambda t, i: ~repeats(t, i))


def has_echo(turns: Column | str = "turns") -> Column:
    """A reply repeats the human turn before it."""
    said = lambda t: T.normalised(t["value"])
    return neighbours(col(turns), lambda a, b: (a["from"] == "human") & (b["from"] == "gpt") & (said(a) != "") & (said(a) == said(b)))


def has_both_roles(turns: Column | str = "turns") -> Column:
    roles = F.transform(col(turns), lambda t: t["from"])
    return F.coalesce(F.array_contains(roles, "human") & F.array_contains(roles, "gpt"), F.lit(False))


def without_last_human(turns: Column | str = "turns") -> Column:
    """One trailing human turn is taken out."""
    x = col(turns)
    return F.when(F.try_element_at(x, F.lit(-1))["from"] == "human", F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x)


def judge(df: DataFrame, turns_col: str = "turns", blank: bool = True, open_ending: bool = True, null_reply: bool = True, repeated_system: bool = True, allow_empty_system: bool = True, echo: bool = True) -> DataFrame:
    """Add `verdict` (why a conversation goes, or `kept`) and replace the turns by the cleaned ones."""
    x = F.col(turns_col)
    rules = [(blank, "blank_turn", has_blank_turn(x)), (open_ending, "invalid_ending", has_open_ending(x)), (null_reply, "null_gpt", has_null_reply(x)), (not allow_empty_system, "empty_system", has_empty_system(x))]
    first = F.lit(None).cast("string")
    for on, name, test in reversed(rules):
        if on:
            first = F.when(test, name).otherwise(first)
    out = df.withColumn("_first", first)
    if repeated_system:
        out = out.withColumn(turns_col, without_repeated_system(x))
    verdict = F.coalesce(F.col("_first"), F.when(has_echo(x), "echo") if echo else F.lit(None), F.when(~has_both_roles(x), "missing_role"), F.lit("kept"))
    return out.withColumn("verdict", verdict).drop("_first").withColumn(turns_col, without_last_human(x))


def keep_valid(df: DataFrame, **toggles) -> DataFrame:
    return judge(df, **toggles).where("verdict = 'kept'").drop("verdict")


def verdict_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count("*").alias("n"))


def drop_phrase_heavy(df: DataFrame, phrases: Sequence[str], multiplier: float | None = 0.69, turns_col: str = "turns") -> DataFrame:
    """Add `matches` (distinct phrases in each reply, summed) and `kept`: below multiplier times the mean of all rows."""
    each = F.transform(of_role("gpt", turns_col), lambda t: T.count_phrases(t["value"], phrases))
    counted = df.withColumn("matches", F.aggregate(each, F.lit(0), lambda s, n: s + n))
    if multiplier is None:
        return counted.withColumn("kept", F.lit(True))
    mean = counted.agg(F.coalesce(F.avg("matches"), F.lit(0.0)).alias("_mean"))  # one row
    return counted.join(F.broadcast(mean)).withColumn("kept", (F.col("_mean") == 0) | (F.col("matches") < F.col("_mean") * multiplier)).drop("_mean")


def drop_with_strings(df: DataFrame, strings: Sequence[str], turns_col: str = "turns") -> DataFrame:
    return df.where(~T.contains_any(values_text(turns_col, " "), strings))


def passes_terms(text: Column | str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """After tags are taken out: one of the included terms (if any is given) and none of the excluded."""
    said = T.without_tags(F.coalesce(col(text), F.lit("")))
    norm = lambda terms: [" ".join(t.lower().split()) for t in terms if t.strip()]
    wanted = T.contains_any(said, norm(include)) if norm(include) else F.lit(True)
    return wanted & ~T.contains_any(said, norm(exclude))


def large_enough(width: Column | str, height: Column | str, least_width: int, least_height: int) -> Column:
    return (F.coalesce(col(width), F.lit(0)) >= least_width) & (F.coalesce(col(height), F.lit(0)) >= least_height)


# Phrases at which a generation is given up, and those at which it is tried again.
REFUSALS = ["Upon further reflection", "I can't engage"]
FORCED_RETRIES = ["shivers down"]


def matches_any(text: Column | str, patterns: Sequence[str]) -> Column:
    return F.coalesce(col(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def generation_verdict(text: Column | str, refusals: Sequence[str] = REFUSALS, retries: Sequence[str] = FORCED_RETRIES) -> Column:
    """refused, retry or kept, as the text holds one of the phrases; refusals come first."""
    return F.when(matches_any(text, refusals), "refused").when(matches_any(text, retries), "retry").otherwise("kept")


def encodable(text: Column | str) -> Column:
    """Whether a text can be stored as UTF-8: Spark's strings always can, so it is true wherever there is a text."""
    return F.when(col(text).isNotNull(), F.lit(True))


# The levels of image requests, from strict to open.
NSFW_LEVELS = ["None", "Soft", "Mature", "X"]


def requested(df: DataFrame, level: str | None = None, since: str | None = None, sort: Sequence[Column] = (), level_col: str = "nsfwLevel", time_col: str = "createdAt") -> DataFrame:
    """What a request with these parameters returns: rows of at most this level, not before this time, in this order."""
    out = df
    if level is not None:
        out = out.where(F.col(level_col).isin(NSFW_LEVELS[: NSFW_LEVELS.index(level) + 1]))
    if since is not None:
        out = out.where(F.col(time_col) >= F.lit(since).cast(dict(df.dtypes)[time_col]))
    return out.orderBy(*sort) if sort else out


def refusal_share(df: DataFrame, scores: DataFrame, id_col: str, threshold: float = 0.75, keep_refusals: bool = False) -> DataFrame:
    """id, n, n_positive, n_negative and kept, of sentences with two scores (pos, neg), counted where they exceed the threshold.

    keep_refusals keeps rows with a positive sentence; else rows without one are kept, and the two scores change their
    places, as the model's classes do between the modes.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    pos, neg = ("pos", "neg") if keep_refusals else ("neg", "pos")
    each = scores.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(F.col(pos) > threshold).alias("n_positive"), F.count_if(F.col(neg) > threshold).alias("n_negative"))
    out = df.select(id_col).join(each, id_col, "left").na.fill(0, ["n", "n_positive", "n_negative"])
    return out.withColumn("kept", F.col("n_positive") > 0 if keep_refusals else F.col("n_positive") == 0)


def fits_request(width: Column | str, height: Column | str, size: Column | str, most_side: int = 2048, most_base64: int = 20 * 1024 * 1024) -> Column:
    """Scaled width and height for a request, and whether its base64 form is small enough."""
    scale = F.least(F.lit(1.0), F.lit(float(most_side)) / F.greatest(col(width), col(height)))
    return F.struct(F.floor(col(width) * scale).cast("int").alias("width"), F.floor(col(height) * scale).cast("int").alias("height"), (F.ceil(col(size) / 3) * 4 <= most_base64).alias("fits"))


def name_matches(name: Column | str, patterns: Sequence[str]) -> Column:
    return T.contains_any(F.lower(col(name)), [p.lower() for p in patterns])


def sentence_share(df: DataFrame, scores: DataFrame, id_col: str, least: float, positive: float = 0.5, margin: float = 0.1) -> DataFrame:
    """id, n, n_positive and kept: the share of sentences scored over positive + margin is at most `least`; no sentence: kept."""
    each = scores.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if(F.col("score") > positive + margin).alias("n_positive"))
    out = df.select(id_col).join(each, id_col, "left").na.fill(0, ["n", "n_positive"])
    return out.withColumn("kept", (F.col("n") == 0) | (F.col("n_positive") / F.greatest("n", F.lit(1)) <= least))


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))

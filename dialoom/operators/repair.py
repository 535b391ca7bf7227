"""Validation and repair of message lists, array<struct<role, content>>."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dialoom.functions.text import col, let, strip
from dialoom.functions.turns import CANONICAL, MESSAGE, map_role, turn

MESSAGES = "array<struct<role:string,content:string>>"
CLOSING = "I understand."


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"), content.cast("string").alias("content"))


def to_turns(messages: Column | str) -> Column:
    return F.transform(col(messages), lambda m: turn(map_role(m["role"], CANONICAL), m["content"]))


def to_messages(turns: Column | str) -> Column:
    return F.transform(col(turns), lambda t: message(map_role(t["from"], MESSAGE), t["value"]))


def why_invalid(messages: Column | str) -> Column:
    """The first thing that is wrong, or null."""

    def check(m: Column) -> Column:
        lead = F.when(F.get(m, F.lit(0))["role"] == "system", 1).otherwise(0)
        n = F.size(m)
        place = lambda i: F.concat(F.lit("Message "), i.cast("string"))
        shape = F.transform(m, lambda x, i: F.when(x["role"].isNull(), F.concat(place(i), F.lit(" has no role"))).when(x["content"].isNull(), F.concat(place(i), F.lit(" has no content"))).when(~x["role"].isin("system", "user", "assistant"), F.concat(place(i), F.lit(" has an invalid role"))))
        turn_of = lambda i: F.when((i - lead) % 2 == 0, "user").otherwise("assistant")
        order = F.transform(m, lambda x, i: F.when((i == 0) & (lead == 1), F.lit(None)).when(x["role"] != turn_of(i), F.when(i == lead, "First non-system message is not from the user").otherwise(F.concat(place(i), F.lit(" breaks alternation")))))
        first = lambda a: F.filter(a, lambda e: e.isNotNull())
        return (
            F.when(m.isNull() | (n == 0), "Empty messages list")
            .when(F.size(first(shape)) > 0, F.get(first(shape), F.lit(0)))
            .when(n == lead, "Only system message present")
            .when(F.size(first(order)) > 0, F.get(first(order), F.lit(0)))
            .when(F.element_at(m, -1)["role"] == "user", "Conversation ends on user")
        )

    return let(col(messages), check)


# Role words that mean the user or the assistant.
USER_ROLES = ["human", "user"]


def fix(messages: Column | str) -> Column:
    """Messages without a role or content go, roles are mapped (unknown ones are the assistant), contents stripped, blank ones
    a space. Of several system messages the first stays where it is; a single one goes to the front. Behind a leading system
    message roles are forced to alternate, and a closing reply is added; null if fewer than two messages are left."""
    known = lambda r: F.when(F.lower(r).isin(USER_ROLES), "user").when(F.lower(r) == "system", "system").otherwise("assistant")
    said = lambda c: F.when(strip(c) == "", F.lit(" ")).otherwise(strip(c))
    is_system = lambda m: m["role"] == "system"

    def one_system(clean: Column) -> Column:
        first = F.array_position(F.transform(clean, lambda m: m["role"]), F.lit("system")) - 1
        several = F.filter(clean, lambda m, i: ~is_system(m) | (i == first))
        single = F.concat(F.filter(clean, is_system), F.filter(clean, lambda m: ~is_system(m)))
        systems = F.size(F.filter(clean, is_system))
        return F.when(F.size(clean) >= 2, F.when(systems > 1, several).when(systems == 1, single).otherwise(clean))

    def alternating(kept: Column) -> Column:
        lead = F.when(F.get(kept, F.lit(0))["role"] == "system", 1).otherwise(0)
        forced = F.transform(kept, lambda m, i: F.when(i < lead, m).otherwise(message(F.when((i - lead) % 2 == 0, "user").otherwise("assistant"), m["content"])))
        reply = F.when((F.size(kept) - lead) % 2 == 1, F.array(message("assistant", F.lit(CLOSING)))).otherwise(F.array().cast(MESSAGES))
        return F.when(F.size(kept) > lead, F.concat(forced, reply))

    whole = F.filter(col(messages), lambda m: (F.coalesce(m["role"], F.lit("")) != "") & m["content"].isNotNull())
    clean = F.transform(whole, lambda m: message(known(m["role"]), said(m["content"])))
    return let(let(clean, one_system), alternating)


def with_system(messages: Column | str, prompt: Column | str) -> Column:
    """The prompt as the leading system message, in place of one that is there."""
    rest = lambda m: F.when(F.get(m, F.lit(0))["role"] == "system", F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    return F.concat(F.array(message("system", F.lit(prompt) if isinstance(prompt, str) else prompt)), let(col(messages), rest))


def complete_turns(turns: Column | str) -> Column:
    """Only turns with a role and a value; null if none is left."""
    kept = F.filter(col(turns), lambda t: t["from"].isNotNull() & t["value"].isNotNull())
    return F.when(F.size(kept) > 0, kept)


def tagged_turns(text: Column | str, tags: dict[str, tuple[str, str]], system: str | None = None, first: int = 0) -> Column:
    """Turns of a transcript between literal start and end tags; the first `first` are skipped, the system turn is added."""
    x, roles = col(text), list(tags)
    sign = "\x01"
    for k, role in enumerate(roles):
        x = F.replace(F.replace(x, F.lit(tags[role][0]), F.lit(f"{sign}{k}")), F.lit(tags[role][1]), F.lit(""))
    names = F.array(*map(F.lit, roles))
    parts = F.filter(F.split(x, sign), lambda p, i: i > 0)
    made = F.transform(parts, lambda p: turn(F.get(names, F.substring(p, 1, 1).cast("int")), strip(F.substring(p, 2, 2**31 - 1))))
    kept = F.filter(made, lambda t, i: i >= first)
    return kept if system is None else F.concat(F.array(turn("system", F.lit(system))), kept)


def balanced(text: str | None, opening: str, closing: str) -> str | None:
    """The JSON between the first opening bracket and its partner, code fences aside; null if it doesn't parse."""
    if text is None:
        return None
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    for candidate in (body, _within(body, opening, closing)):
        try:
            found = json.loads(candidate or "")
        except ValueError:
            continue
        if isinstance(found, list if opening == "[" else dict):
            return json.dumps(found, ensure_ascii=False, separators=(",", ":"))
    return None


def _within(body: str, opening: str, closing: str) -> str | None:
    start = body.find(opening)
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(body) if start >= 0 else start):
        c = body[k]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return body[start : k + 1]
    return None


@F.pandas_udf(StringType())
def json_array(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: balanced(x, "[", "]"))


@F.pandas_udf(StringType())
def json_object(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: balanced(x, "{", "}"))

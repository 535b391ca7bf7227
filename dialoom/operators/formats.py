"""Chat formats: detection on VARIANT documents, and conversion to canonical turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.functions.storage import written
from dialoom.functions.text import fuzzy_ratio, strip
from dialoom.functions.turns import CANONICAL, TURNS, map_role, turn

# The turn of rows without any, and the marks of ChatML.
SENTINEL = "No conversations found."
CHATML = r"(?s)<\|im_start\|>([^\n]+)\n(.*?)<\|im_end\|>"
MARKS = ["<|im_start|>", "<|im_end|>"]
# Role words of the known formats.
VICUNA_ROLES = ["user", "assistant", "system", "human", "gpt"]


def at(doc: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc if isinstance(doc, Column) else F.col(doc), path, kind)


def has(doc: Column | str, path: str) -> Column:
    """The key is there, whatever it holds."""
    return at(doc, path, "variant").isNotNull()


def text_at(doc: Column | str, path: str, absent: str | None = None) -> Column:
    """A string at the path; null for anything else, and `absent` where there is nothing."""
    found = at(doc, path, "variant")
    return F.when(found.isNull(), F.lit(absent)).when(F.schema_of_variant(found) == "STRING", at(doc, path))


def pairs_at(doc: Column | str, path: str, role: str, content: str, absent: str | None = "") -> Column:
    """role and content of the objects of a list; values that aren't strings are null, missing contents are `absent`."""
    items = F.filter(at(doc, path, "array<variant>"), lambda m: F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)))
    return F.transform(items, lambda m: F.struct(text_at(m, f"$.{role}", "").alias("role"), text_at(m, f"$.{content}", absent).alias("content")))


def marked(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1])), F.lit(False))


def has_marks(doc: str) -> Column:
    """ChatML marks in the content of a message or in a string of the document itself, but no deeper."""
    said = F.exists(at(doc, "$.messages", "array<variant>"), lambda m: marked(F.to_json(at(m, "$.content", "variant"))))
    own = F.exists(F.map_values(at(doc, "$", "map<string,variant>")), lambda v: (F.schema_of_variant(v) == "STRING") & marked(at(v, "$")))
    return F.coalesce(said, F.lit(False)) | F.coalesce(own, F.lit(False))


def row_format(doc: str = "_doc") -> Column:
    """The format a row shows, or null."""
    first, message = "$.conversations[0]", "$.messages[0]"
    return (
        F.when(has(doc, f"{first}.from") & has(doc, f"{first}.value"), "sharegpt")
        .when(has(doc, f"{message}.role") & has(doc, f"{message}.content"), "huggingface")
        .when(has(doc, "$.instruction") | (has(doc, "$.input") & has(doc, "$.output")), "alpaca")
        .when(F.lower(text_at(doc, f"{first}.from")).isin(VICUNA_ROLES), "vicuna")
        .when(has_marks(doc), "chatml")
    )


def format_of_row(doc: str = "_doc") -> Column:
    """The format of a document on its own: messages of any shape count where nothing else is shown."""
    return F.coalesce(row_format(doc), F.when(has(doc, "$.messages"), "huggingface"), F.lit("unknown"))


def detect_format(df: DataFrame, group: str, order: str, sample: int = 5, doc: str = "_doc") -> DataFrame:
    """group and format: the first of its first `sample` rows that shows a format decides; if none does, messages of any shape
    in one of them; else unknown."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(order))
    ranked = df.select(group, row_format(doc).alias("f"), has(doc, "$.messages").alias("m"), first.alias("rn")).where(F.col("rn") <= sample)
    verdict = ranked.groupBy(group).agg(F.min_by(F.col("f"), F.when(F.col("f").isNotNull(), F.col("rn"))).alias("format"), F.bool_or("m").alias("m"))
    return verdict.select(group, F.coalesce("format", F.when(F.col("m"), "huggingface"), F.lit("unknown")).alias("format"))


def plain_role(role: Column) -> Column:
    """user and assistant become human and gpt; known roles stay; others are null."""
    low = F.lower(F.coalesce(role, F.lit("")))
    return F.when(low == "user", "human").when(low == "assistant", "gpt").when(low.isin("system", "human", "gpt"), low)


def vicuna_role(role: Column) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))
    holds = lambda *w: F.exists(F.array(*map(F.lit, w)), lambda x: F.contains(low, x))
    return F.coalesce(plain_role(role), F.when(holds("user", "human"), "human").when(holds("assistant", "gpt", "bot"), "gpt").when(holds("system"), "system"))


def _turns(pairs: Column, who, role: str, value: str) -> Column:
    made = F.transform(pairs, lambda m: turn(who(m[role]), strip(m[value])))
    return F.filter(made, lambda t: t["from"].isNotNull() & (F.coalesce(t["value"], F.lit("")) != ""))


def from_messages(messages: Column) -> Column:
    return _turns(messages, plain_role, "role", "content")


def from_vicuna(turns: Column) -> Column:
    return _turns(turns, vicuna_role, "from", "value")


def from_alpaca(instruction: Column, given: Column, output: Column) -> Column:
    part = lambda x: F.nullif(strip(F.coalesce(x, F.lit(""))), F.lit(""))
    asked = F.nullif(F.concat_ws("\n", part(instruction), part(given)), F.lit(""))
    return F.filter(F.array(turn("human", asked), turn("gpt", part(output))), lambda t: t["value"].isNotNull())


def from_chatml(text: Column) -> Column:
    roles = F.regexp_extract_all(text, F.lit(CHATML), F.lit(1))
    said = F.regexp_extract_all(text, F.lit(CHATML), F.lit(2))
    return _turns(F.zip_with(roles, said, lambda r, v: F.struct(r.alias("role"), v.alias("content"))), lambda r: plain_role(strip(r)), "role", "content")


def from_canonical(turns: Column) -> Column:
    """Roles lower-cased and mapped, unknown ones and empty values kept, null values dropped."""
    low = lambda r: F.lower(F.coalesce(r, F.lit("")))
    return F.transform(F.filter(turns, lambda t: t["value"].isNotNull()), lambda t: turn(F.coalesce(plain_role(t["from"]), low(t["from"])), strip(t["value"])))


def as_turns(pairs: Column) -> Column:
    return F.transform(pairs, lambda m: turn(m["role"], m["content"]))


def from_fields(doc: Column) -> Column:
    """Rows of no known format: conversations, else a system field and a completion (a list or JSON of one) or, without one,
    messages. Only `user` and `assistant` are mapped; other roles and empty values stay."""
    kept = lambda pairs: F.transform(pairs, lambda m: turn(map_role(m["role"], CANONICAL), strip(F.coalesce(m["content"], F.lit("")))))
    none = F.array().cast(TURNS)
    completion = F.coalesce(pairs_at(doc, "$.completion", "role", "content"), pairs_at(F.try_parse_json(text_at(doc, "$.completion")), "$", "role", "content"))
    rest = F.when(has(doc, "$.completion"), completion).otherwise(pairs_at(doc, "$.messages", "role", "content"))
    system = text_at(doc, "$.system")
    lead = F.when(system.isNotNull(), F.array(turn("system", strip(system)))).otherwise(none)
    return F.coalesce(kept(pairs_at(doc, "$.conversations", "from", "value")), F.concat(lead, F.coalesce(kept(rest), none)))


def or_sentinel(turns: Column) -> Column:
    return F.when(F.size(F.coalesce(turns, F.array().cast(TURNS))) == 0, F.array(turn("system", F.lit(SENTINEL)))).otherwise(turns)


def chatml_text(doc: Column | str) -> Column:
    """The first of text, content, prompt and messages that is a string with marks, or the first message's content that opens
    one; null without."""
    own = [F.when(marked(text_at(doc, f"$.{k}")), text_at(doc, f"$.{k}")) for k in ("text", "content", "prompt", "messages")]
    said = F.filter(pairs_at(doc, "$.messages", "role", "content"), lambda m: F.coalesce(F.contains(m["content"], F.lit(MARKS[0])), F.lit(False)))
    return F.coalesce(*own, F.get(said, F.lit(0))["content"])


def extract(doc: str, fmt: Column) -> Column:
    """Canonical turns of a document by its format; the sentinel where nothing is found."""
    d = F.col(doc)
    messages, turns = pairs_at(doc, "$.messages", "role", "content"), as_turns(pairs_at(doc, "$.conversations", "from", "value"))
    text = chatml_text(doc)
    made = (
        F.when(fmt == "sharegpt", from_canonical(turns))
        .when(fmt == "huggingface", from_messages(messages))
        .when(fmt == "alpaca", from_alpaca(text_at(doc, "$.instruction"), text_at(doc, "$.input"), text_at(doc, "$.output")))
        .when(fmt == "vicuna", from_vicuna(turns))
        .when(fmt == "chatml", F.when(text.isNotNull(), from_chatml(text)).otherwise(from_messages(messages)))
        .otherwise(from_fields(d))
    )
    return or_sentinel(made)


def salvage(line: Column) -> Column:
    """Turns of a raw line: what follows each role word and colon; else the line as a turn of the role word that it nearly
    is; else one turn, `unknown`. `assistant` becomes gpt, `user` stays."""
    names = {"system": "system", "user": "user", "assistant": "gpt"}
    part = lambda word: F.when(F.contains(line, F.lit(f"{word}:")), turn(names[word], strip(F.substr(line, F.locate(f"{word}:", line) + len(word) + 1))))
    found = F.filter(F.array(*map(part, names)), lambda t: t.isNotNull())
    who = F.lit("unknown")
    for word in reversed(names):
        who = F.when(fuzzy_ratio(F.lower(line), word) > 70, names[word]).otherwise(who)
    return F.when(F.size(found) > 0, found).otherwise(F.array(turn(who, strip(line))))


def convert(scanned: DataFrame, group: str = "_file", order: str = "_pos", per_row: bool = False) -> DataFrame:
    """group, order, format and turns of scanned documents; malformed lines are salvaged."""
    if per_row:
        known = scanned.withColumn("format", format_of_row("_doc"))
    else:
        known = scanned.join(detect_format(scanned.where("_doc is not null"), group, order, 10), group, "left")  # a row a file
    turns = F.when(F.col("_doc").isNull(), salvage(F.col("_raw"))).otherwise(extract("_doc", F.col("format")))
    return known.select(group, order, F.coalesce("format", F.lit("unknown")).alias("format"), turns.alias("turns"))


def convert_files(scanned: DataFrame, folder: str, group: str = "_file", order: str = "_pos", preview: int = 3) -> DataFrame:
    """Convert every file into one of its own, `<folder>/source=<name>/`, its lines in their order. Returns, for each file, its
    name, format, number of conversations and the first `preview` of them as JSON."""
    done = written(convert(scanned, group, order), "converted").withColumn("source", F.regexp_replace(F.element_at(F.split(group, "/"), -1), r"\.[^.]*$", ""))
    line = F.to_json(F.struct(F.col("turns").alias("conversations")), {"ignoreNullFields": "false"})
    done.select("source", order, line.alias("value")).repartitionByRange("source", order).sortWithinPartitions("source", order).select("source", "value").write.partitionBy("source").text(folder)
    ranked = done.select("source", "format", order, line.alias("line"), F.row_number().over(Window.partitionBy("source").orderBy(order)).alias("rn"))
    return ranked.groupBy("source").agg(F.min("format").alias("format"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rn") <= preview, F.struct(order, "line")))).alias("p")).select("source", "format", "n", F.transform("p", lambda x: x["line"]).alias("preview"))

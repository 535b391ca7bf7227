"""Queries over conversations: nesting, formats, repair, filters, exact duplicates; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.functions.turns import digest, flatten, map_role, nest, turn, values_text
from dialoom.operators import dedup, filters, formats, repair, reshape, stats
from dialoom.plans.base import Registry, table

REG = Registry()

#: Defects, put in alike on both engines: blank, open, null and echoing turns, system turns, a role missing, copies.
DEFECTS = """
SELECT conv_id, turn, role,
  CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN '   ' WHEN conv_id % 11 = 5 AND turn = 2 THEN 'and then'
       WHEN conv_id % 13 = 4 AND turn = 1 THEN NULL WHEN conv_id % 17 = 6 AND turn <= 1 THEN 'Say  the same.'
       ELSE text END AS text
FROM conversations WHERE NOT (conv_id % 19 = 7 AND role = 'assistant')
UNION ALL
SELECT conv_id, -1, 'system', CASE conv_id % 3 WHEN 0 THEN ' Be brief. ' WHEN 1 THEN '' ELSE upper(text) END
FROM conversations WHERE turn = 0 AND conv_id % 5 = 2
UNION ALL
SELECT conv_id + 100000, turn, role, text FROM conversations WHERE conv_id % 6 = 1
"""

SP = r"[\s\pZ\x1C-\x1F\x85]"
STRIP = rf"regexp_replace({{0}}, '^{SP}+|{SP}+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x)


BASE = f"""d AS ({DEFECTS}),
n AS (SELECT conv_id, list({{'f': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, 'v': text}} ORDER BY turn) AS t FROM d GROUP BY conv_id)"""
SAID = "sha256(array_to_string(list_transform({0}, lambda x: coalesce(x.f, '<null>') || ':' || coalesce(x.v, '<null>')), chr(10)))"
BLANK = f"coalesce({_strip('x.v')}, '') = ''"
OPEN = f"coalesce(regexp_matches({_strip('x.v')}, '[a-zA-Z0-9,]$'), false)"


def any_turn(test: str, t: str = "t") -> str:
    return f"len(list_filter({t}, lambda x: {test})) > 0"


def read_alike(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL's rows, with capitals as DuckDB makes them."""
    c = table(spark, sf_dir, "conversations").withColumn("raised", T.capitals("text"))
    return spark.sql(sql.replace("FROM conversations", "FROM {c}").replace("upper(text)", "raised"), c=c)


def defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest(read_alike(spark, sf_dir, DEFECTS))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest(table(spark, sf_dir, "conversations"))


def shown(df: DataFrame, turns: str = "turns") -> DataFrame:
    return df.select("conv_id", F.size(turns).cast("long").alias("n"), digest(turns).alias("said"))


CLEAN = BASE.replace(DEFECTS, "SELECT * FROM conversations")


@REG.query("nest_conversations", f"WITH {CLEAN} SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM n")
def nest_conversations(spark, sf_dir):
    return shown(clean(spark, sf_dir))


@REG.query("flatten_conversations", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS \"from\", length(text) AS chars FROM conversations")
def flatten_conversations(spark, sf_dir):
    return flatten(clean(spark, sf_dir)).select("conv_id", "turn", "from", F.length("value").cast("long").alias("chars"))


KEY = "sha256(array_to_string(list_filter(list_transform(t, lambda x: x.v), lambda v: v IS NOT NULL), ''))"


@REG.query("exact_dedup_conversations", f"WITH {BASE}, k AS (SELECT *, {KEY} AS sha FROM n) SELECT min(conv_id) AS conv_id, sha FROM k GROUP BY sha")
def exact_dedup_conversations(spark, sf_dir):
    return dedup.exact_conversations(defective(spark, sf_dir), "conv_id").select("conv_id", "sha")


@REG.query("blank_turns", f"WITH {BASE} SELECT conv_id FROM n WHERE {any_turn(f'''x.f <> 'system' AND {BLANK}''')}")
def blank_turns(spark, sf_dir):
    return defective(spark, sf_dir).where(filters.has_blank_turn()).select("conv_id")


@REG.query("invalid_endings", f"WITH {BASE} SELECT conv_id FROM n WHERE {any_turn(OPEN)}")
def invalid_endings(spark, sf_dir):
    return defective(spark, sf_dir).where(filters.has_open_ending()).select("conv_id")


@REG.query("null_gpt", f"WITH {BASE} SELECT conv_id FROM n WHERE {any_turn('''x.f = 'gpt' AND x.v IS NULL''')}")
def null_gpt(spark, sf_dir):
    return defective(spark, sf_dir).where(filters.has_null_reply()).select("conv_id")


@REG.query("empty_system", f"WITH {BASE} SELECT conv_id FROM n WHERE {any_turn(f'''x.f = 'system' AND {BLANK}''')}")
def empty_system(spark, sf_dir):
    return defective(spark, sf_dir).where(filters.has_empty_system()).select("conv_id")


def low(x: str) -> str:
    return f"lower({_strip(x)})"


UNREPEATED = f"list_filter(t, lambda x, i: NOT coalesce(x.f = 'system' AND t[i + 1].f = 'human' AND {low('x.v')} = {low('t[i + 1].v')}, false))"
NORMAL = "lower(regexp_replace(" + _strip("{0}") + rf", '{SP}+', ' ', 'g'))"
ECHO = f"len(list_filter(range(1, len({{0}})), lambda i: coalesce({{0}}[i].f = 'human' AND {{0}}[i + 1].f = 'gpt' AND {NORMAL.format('{0}[i].v')} <> '' AND {NORMAL.format('{0}[i].v')} = {NORMAL.format('{0}[i + 1].v')}, false))) > 0"


@REG.query("duplicate_system", f"WITH {BASE}, u AS (SELECT conv_id, {UNREPEATED} AS t FROM n) SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM u")
def duplicate_system(spark, sf_dir):
    return shown(defective(spark, sf_dir).withColumn("turns", filters.without_repeated_system()))


@REG.query("echo_turns", f"WITH {BASE} SELECT conv_id FROM n WHERE {ECHO.format('t')}")
def echo_turns(spark, sf_dir):
    return defective(spark, sf_dir).where(filters.has_echo()).select("conv_id")


BOTH = "len(list_filter({0}, lambda x: x.f = 'human')) > 0 AND len(list_filter({0}, lambda x: x.f = 'gpt')) > 0"
TRIMMED = "CASE WHEN {0}[-1].f = 'human' THEN {0}[1:len({0}) - 1] ELSE {0} END"


@REG.query("role_presence", f"WITH {BASE} SELECT conv_id FROM n WHERE {BOTH.format('t')}")
def role_presence(spark, sf_dir):
    return defective(spark, sf_dir).where(filters.has_both_roles()).select("conv_id")


@REG.query("trim_trailing_human", f"WITH {CLEAN}, u AS (SELECT conv_id, {TRIMMED.format('t')} AS t FROM n) SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM u")
def trim_trailing_human(spark, sf_dir):
    return shown(clean(spark, sf_dir).withColumn("turns", filters.without_last_human()))


JUDGED = f"""u AS (SELECT conv_id, t, {UNREPEATED} AS w FROM n),
j AS (SELECT conv_id, {TRIMMED.format('w')} AS t, CASE WHEN {any_turn(f"x.f <> 'system' AND {BLANK}")} THEN 'blank_turn' WHEN {any_turn(OPEN)} THEN 'invalid_ending'
  WHEN {any_turn("x.f = 'gpt' AND x.v IS NULL")} THEN 'null_gpt' WHEN {any_turn(f"x.f = 'system' AND {BLANK}")} THEN 'empty_system'
  WHEN {ECHO.format('w')} THEN 'echo' WHEN NOT ({BOTH.format('w')}) THEN 'missing_role' ELSE 'kept' END AS verdict FROM u)"""


@REG.query("filter_composite", f"WITH {BASE}, {JUDGED} SELECT conv_id, verdict, len(t) AS n, {SAID.format('t')} AS said FROM j")
def filter_composite(spark, sf_dir):
    return filters.judge(defective(spark, sf_dir), allow_empty_system=False).select("conv_id", "verdict", F.size("turns").cast("long").alias("n"), digest().alias("said"))


@REG.query("filter_counters", f"WITH {BASE}, {JUDGED} SELECT verdict, count(*) AS n FROM j GROUP BY verdict")
def filter_counters(spark, sf_dir):
    return filters.verdict_counts(filters.judge(defective(spark, sf_dir), allow_empty_system=False))


PHRASES = ["tion", "ing the", "of ", "and", "erth"]
MATCHES = "list_sum([0] || list_transform(list_filter(t, lambda x: x.f = 'gpt'), lambda x: " + " + ".join(f"coalesce(CAST(contains(x.v, '{p}') AS INTEGER), 0)" for p in PHRASES) + "))"


@REG.query("phrase_slop", f"WITH {BASE}, m AS (SELECT conv_id, CAST({MATCHES} AS INTEGER) AS matches FROM n), a AS (SELECT avg(matches) AS mean FROM m) SELECT conv_id, matches, mean = 0 OR matches < mean * 0.69 AS kept FROM m, a")
def phrase_slop(spark, sf_dir):
    return filters.drop_phrase_heavy(defective(spark, sf_dir), PHRASES).select("conv_id", "matches", "kept")


@REG.query("exclude_strings", f"WITH {BASE} SELECT conv_id FROM n WHERE NOT contains(array_to_string(list_filter(list_transform(t, lambda x: x.v), lambda v: v IS NOT NULL), ' '), 'tionth') AND NOT contains(array_to_string(list_filter(list_transform(t, lambda x: x.v), lambda v: v IS NOT NULL), ' '), 'Erou')")
def exclude_strings(spark, sf_dir):
    return filters.drop_with_strings(defective(spark, sf_dir), ["tionth", "Erou"]).select("conv_id")


@REG.query("refusal_phrases", "SELECT conv_id, turn, regexp_matches(text, 'Erth|tion the|As an AI') AS refuses FROM conversations WHERE role = 'assistant'")
def refusal_phrases(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", filters.matches_any("text", ["Erth", "tion the", "As an AI"]).alias("refuses"))


# Formats: the table is written in each format within the query, then converted back.

MESSAGES_OF = "list({'role': CASE WHEN turn = 3 THEN 'Tool' WHEN turn % 2 = 0 THEN 'User' ELSE 'assistant' END, 'content': CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN '  ' ELSE ' ' || text || chr(10) END} ORDER BY turn)"
AS_ROLE = "CASE lower({0}) WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE lower({0}) END"


def messages(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("turn") == 3, "Tool").when(F.col("turn") % 2 == 0, "User").otherwise("assistant")
    said = F.when((F.col("conv_id") % 9 == 4) & (F.col("turn") == 1), "  ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    rows = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), said.alias("content"))))
    return c.groupBy("conv_id").agg(rows.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))


CONVERTED = f"list_transform(list_filter(m, lambda x: lower(x.role) <> 'tool' AND {_strip('x.content')} <> ''), lambda x: {{'f': {AS_ROLE.format('x.role')}, 'v': {_strip('x.content')}}})"
FROM_MESSAGES = f"WITH m AS (SELECT conv_id, {MESSAGES_OF} AS m FROM conversations GROUP BY conv_id), u AS (SELECT conv_id, {CONVERTED} AS t FROM m) SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM u"


@REG.query("map_roles", FROM_MESSAGES)
def map_roles(spark, sf_dir):
    return shown(messages(spark, sf_dir).withColumn("turns", formats.from_messages(F.col("m"))))


@REG.query("chatml_roundtrip", FROM_MESSAGES)
def chatml_roundtrip(spark, sf_dir):
    lines = F.transform("m", lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["content"], F.lit("<|im_end|>")))
    return shown(messages(spark, sf_dir).withColumn("turns", formats.from_chatml(F.array_join(lines, "\n"))))


@REG.query("variant_messages", FROM_MESSAGES)
def variant_messages(spark, sf_dir):
    docs = messages(spark, sf_dir).select("conv_id", F.try_parse_json(F.to_json(F.struct(F.col("m").alias("messages")))).alias("_doc"))
    return shown(docs.withColumn("turns", formats.extract("_doc", formats.format_of_row("_doc"))))


@REG.query(
    "vicuna_roles",
    "WITH r AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'EndUser' WHEN 1 THEN 'ChatBot' WHEN 2 THEN 'human' WHEN 3 THEN 'Narrator' ELSE 'system-x' END AS f, trim(text) AS v FROM conversations), "
    "n AS (SELECT conv_id, list({'f': CASE f WHEN 'EndUser' THEN 'human' WHEN 'ChatBot' THEN 'gpt' WHEN 'human' THEN 'human' ELSE 'system' END, 'v': v} ORDER BY turn) AS t FROM r WHERE f <> 'Narrator' GROUP BY conv_id) "
    f"SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM n",
)
def vicuna_roles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    who = F.when(F.col("turn") % 5 == 0, "EndUser").when(F.col("turn") % 5 == 1, "ChatBot").when(F.col("turn") % 5 == 2, "human").when(F.col("turn") % 5 == 3, "Narrator").otherwise("system-x")
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("f"), "text"))).alias("r"))
    return shown(whole.withColumn("turns", formats.from_vicuna(F.transform("r", lambda x: turn(x["f"], x["text"])))))


@REG.query(
    "alpaca_from_pairs",
    "WITH a AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS i, max(CASE WHEN turn = 2 THEN text END) AS g, max(CASE WHEN turn = 1 THEN text END) AS o FROM conversations GROUP BY conv_id), "
    "t AS (SELECT conv_id, list_filter([{'f': 'human', 'v': nullif(concat_ws(chr(10), nullif(trim(i), ''), nullif(trim(g), '')), '')}, {'f': 'gpt', 'v': nullif(trim(o), '')}], lambda x: x.v IS NOT NULL) AS t FROM a) "
    f"SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM t",
)
def alpaca_from_pairs(spark, sf_dir):
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    a = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(at(0).alias("i"), at(2).alias("x"), at(1).alias("o"))
    return shown(a.withColumn("turns", formats.from_alpaca(F.col("i"), F.col("x"), F.col("o"))))


FORMATS = """WITH n AS (SELECT conv_id, turn, conv_id % 9 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT conv_id, rn, k, CASE WHEN k = 0 OR k = 6 AND turn > 0 THEN 'sharegpt' WHEN k = 1 THEN 'huggingface' WHEN k = 2 AND turn > 0 THEN 'alpaca' WHEN k = 3 THEN 'vicuna' WHEN k IN (4, 5) THEN 'chatml' END AS f FROM n WHERE rn <= 5)
SELECT conv_id, coalesce(arg_min(f, rn) FILTER (f IS NOT NULL), CASE WHEN min(k) IN (6, 8) THEN 'huggingface' ELSE 'unknown' END) AS format FROM r GROUP BY conv_id"""


@REG.query("detect_format", FORMATS)
def detect_format(spark, sf_dir):
    """Roles in capitals, marks in messages and deep inside, messages of no shape before rows of a known one."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 9
    said = F.col("text")
    marked = F.concat(F.lit("<|im_start|>user\n"), said, F.lit("<|im_end|>"))
    sharegpt = F.to_json(F.struct(F.array(turn("human", said)).alias("conversations")))
    doc = (
        F.when((k == 0) | ((k == 6) & (F.col("turn") > 0)), sharegpt)
        .when(k == 1, F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), said.alias("content"))).alias("messages"))))
        .when((k == 2) & (F.col("turn") > 0), F.to_json(F.struct(said.alias("instruction"))))
        .when(k == 3, F.to_json(F.struct(F.array(F.struct(F.lit("USER").alias("from"))).alias("conversations"))))
        .when(k == 4, F.to_json(F.struct(marked.alias("anything"))))
        .when(k == 5, F.to_json(F.struct(F.array(F.struct(marked.alias("content"))).alias("messages"))))
        .when(k == 6, F.lit('{"messages": [{"x": 1}]}'))
        .when(k == 7, F.to_json(F.struct(F.struct(marked.alias("note")).alias("meta"))))
        .when(k == 8, F.lit('{"messages": []}'))
        .otherwise(F.lit('{"other": 1}'))
    )
    return formats.detect_format(c.select("conv_id", "turn", F.try_parse_json(doc).alias("_doc")), "conv_id", "turn")


SALVAGED = """WITH r AS (SELECT conv_id, turn, turn % 7 AS k, replace(text, ':', ' ') AS v FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS n, CASE k WHEN 0 THEN 'gpt' WHEN 1 THEN 'system' WHEN 2 THEN 'user' WHEN 3 THEN 'gpt' WHEN 4 THEN 'unknown' WHEN 5 THEN 'system' ELSE 'unknown' END AS who FROM r"""


@REG.query("salvage_lines", SALVAGED)
def salvage_lines(spark, sf_dir):
    """Raw lines: role words with colons, words that are nearly roles, and free text."""
    c = table(spark, sf_dir, "conversations")
    said = F.regexp_replace("text", ":", " ")
    k = F.col("turn") % 7
    raw = F.when(k == 0, F.concat(F.lit("x assistant: "), said)).when(k == 1, F.concat(F.lit("user:"), said, F.lit(" system: s"))).when(k == 2, "usar").when(k == 3, "Asistant").when(k == 4, "uxxr").when(k == 5, "sytem").otherwise(said)
    found = c.select("conv_id", "turn", formats.salvage(raw).alias("t"))
    return found.select("conv_id", "turn", F.size("t").alias("n"), F.get("t", F.lit(0))["from"].alias("who"))


UNKNOWN = f"""WITH {BASE}, m AS (SELECT conv_id, list_transform(list_filter(t, lambda x: x.f <> 'system'), lambda x: {{'f': CASE x.f WHEN 'human' THEN 'Narrator' ELSE x.f END, 'v': coalesce({_strip('x.v')}, '')}}) AS t FROM n),
u AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN [{{'f': 'system', 'v': 'Be kind.'}}] ELSE [] END || t AS t FROM m),
s AS (SELECT conv_id, CASE WHEN len(t) = 0 THEN [{{'f': 'system', 'v': 'No conversations found.'}}] ELSE t END AS t FROM u) SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM s"""


@REG.query("system_and_completion", UNKNOWN)
def system_and_completion(spark, sf_dir):
    """Rows of no known format: a system field, and a completion that is a list or JSON of one."""
    said = F.transform(F.filter("turns", lambda t: t["from"] != "system"), lambda t: F.struct(F.when(t["from"] == "human", "Narrator").otherwise("assistant").alias("role"), t["value"].alias("content")))
    rows = defective(spark, sf_dir).select("conv_id", said.alias("c"))
    system = F.when(F.col("conv_id") % 2 == 0, F.lit(" Be kind. "))
    listed = F.to_json(F.struct(system.alias("system"), F.col("c").alias("completion")))
    quoted = F.to_json(F.struct(system.alias("system"), F.to_json("c").alias("completion")))
    docs = rows.select("conv_id", F.try_parse_json(F.when(F.col("conv_id") % 3 == 0, quoted).otherwise(listed)).alias("_doc"))
    return shown(docs.withColumn("turns", formats.extract("_doc", formats.format_of_row("_doc"))))


@REG.query("sentinel_rows", f"WITH {BASE}, u AS (SELECT conv_id, list_filter(t, lambda x: x.f = 'gpt') AS t FROM n), s AS (SELECT conv_id, CASE WHEN len(t) = 0 THEN [{{'f': 'system', 'v': 'No conversations found.'}}] ELSE t END AS t FROM u) SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM s")
def sentinel_rows(spark, sf_dir):
    replies = F.filter("turns", lambda t: t["from"] == "gpt")
    return shown(defective(spark, sf_dir).withColumn("turns", formats.or_sentinel(replies)))


# Repair.

LISTED = f"""d AS ({DEFECTS}), m AS (SELECT conv_id, list({{'f': role, 'v': text}} ORDER BY turn) AS m FROM d GROUP BY conv_id)"""


def listed(spark, sf_dir) -> DataFrame:
    return defective(spark, sf_dir).select("conv_id", repair.to_messages("turns").alias("m"))


def shown_messages(df: DataFrame, column: str) -> DataFrame:
    return shown(df.where(F.col(column).isNotNull()).select("conv_id", F.transform(column, lambda m: turn(m["role"], m["content"])).alias("turns")))


WRONG = "CASE WHEN m[i].f = 'system' AND i = 1 THEN NULL WHEN m[i].f <> CASE WHEN (i - 1 - l) % 2 = 0 THEN 'user' ELSE 'assistant' END THEN CASE WHEN i - 1 = l THEN 'First non-system message is not from the user' ELSE 'Message ' || (i - 1) || ' breaks alternation' END END"
VALID = f"""WITH {LISTED}, l AS (SELECT *, CASE WHEN m[1].f = 'system' THEN 1 ELSE 0 END AS l FROM m),
e AS (SELECT conv_id, m, l, list_filter(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN m[i].v IS NULL THEN 'Message ' || (i - 1) || ' has no content' END), lambda e: e IS NOT NULL) AS a,
  list_filter(list_transform(range(1, len(m) + 1), lambda i: {WRONG}), lambda e: e IS NOT NULL) AS b FROM l)
SELECT conv_id, CASE WHEN len(a) > 0 THEN a[1] WHEN len(m) = l THEN 'Only system message present' WHEN len(b) > 0 THEN b[1] WHEN m[-1].f = 'user' THEN 'Conversation ends on user' ELSE 'ok' END AS reason FROM e"""


@REG.query("validate_messages", VALID)
def validate_messages(spark, sf_dir):
    return listed(spark, sf_dir).select("conv_id", F.coalesce(repair.why_invalid("m"), F.lit("ok")).alias("reason"))


#: Messages with role aliases, padding, and a second system message in their midst; read alike by both engines.
MESSY = f"""SELECT conv_id, CAST(turn AS DOUBLE) AS place, CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'Bot' WHEN role = 'user' AND conv_id % 3 = 1 THEN 'HUMAN' ELSE role END AS role, concat('  ', text) AS text
FROM ({DEFECTS}) WHERE text IS NOT NULL
UNION ALL SELECT conv_id, CAST(turn AS DOUBLE), role, text FROM ({DEFECTS}) WHERE text IS NULL
UNION ALL SELECT conv_id, CAST(0.5 AS DOUBLE), 'System', ' In the midst. ' FROM conversations WHERE turn = 0 AND conv_id % 4 = 1
UNION ALL SELECT conv_id, CAST(0.7 AS DOUBLE), NULL, 'of no role' FROM conversations WHERE turn = 0 AND conv_id % 4 = 2"""
FIXED = f"""WITH m AS (SELECT conv_id, list({{'f': role, 'v': text}} ORDER BY place) AS m FROM ({MESSY}) GROUP BY conv_id),
c AS (SELECT conv_id, list_transform(list_filter(m, lambda x: coalesce(x.f, '') <> '' AND x.v IS NOT NULL), lambda x: {{'f': CASE WHEN lower(x.f) IN ('human', 'user') THEN 'user' WHEN lower(x.f) = 'system' THEN 'system' ELSE 'assistant' END, 'v': CASE WHEN {_strip('x.v')} = '' THEN ' ' ELSE {_strip('x.v')} END}}) AS c FROM m),
s AS (SELECT conv_id, c, list_filter(c, lambda x: x.f = 'system') AS s, list_position(list_transform(c, lambda x: x.f), 'system') AS p FROM c),
k AS (SELECT conv_id, c, CASE WHEN len(s) > 1 THEN list_filter(c, lambda x, i: x.f <> 'system' OR i = p) WHEN len(s) = 1 THEN s || list_filter(c, lambda x: x.f <> 'system') ELSE c END AS k FROM s),
l AS (SELECT conv_id, c, k, CASE WHEN k[1].f = 'system' THEN 1 ELSE 0 END AS l FROM k),
f AS (SELECT conv_id, c, k, l, list_transform(k, lambda x, i: CASE WHEN i <= l THEN x ELSE {{'f': CASE WHEN (i - 1 - l) % 2 = 0 THEN 'user' ELSE 'assistant' END, 'v': x.v}} END) || CASE WHEN (len(k) - l) % 2 = 1 THEN [{{'f': 'assistant', 'v': 'I understand.'}}] ELSE [] END AS t FROM l)
SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM f WHERE len(c) >= 2 AND len(k) > l"""


@REG.query("fix_messages", FIXED)
def fix_messages(spark, sf_dir):
    rows = read_alike(spark, sf_dir, MESSY)
    order = F.array_sort(F.collect_list(F.struct("place", "role", "text")))
    m = rows.groupBy("conv_id").agg(order.alias("m")).select("conv_id", F.transform("m", lambda x: repair.message(x["role"], x["text"])).alias("m"))
    return shown_messages(m.withColumn("t", repair.fix("m")), "t")


@REG.query("upsert_system", f"WITH {LISTED}, u AS (SELECT conv_id, [{{'f': 'system', 'v': 'Be kind.'}}] || CASE WHEN m[1].f = 'system' THEN m[2:] ELSE m END AS t FROM m) SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM u")
def upsert_system(spark, sf_dir):
    return shown_messages(listed(spark, sf_dir).withColumn("t", repair.with_system("m", "Be kind.")), "t")


@REG.query("message_roundtrip", f"WITH {BASE} SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM n")
def message_roundtrip(spark, sf_dir):
    return shown(defective(spark, sf_dir).withColumn("turns", repair.to_turns(repair.to_messages("turns"))))


@REG.query("complete_turns", f"WITH {BASE}, u AS (SELECT conv_id, list_filter(t, lambda x: x.v IS NOT NULL) AS t FROM n) SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM u WHERE len(t) > 0")
def complete_turns(spark, sf_dir):
    return shown(defective(spark, sf_dir).withColumn("turns", repair.complete_turns("turns")).where("turns is not null"))


@REG.query("tagged_transcript", f"WITH {CLEAN}, u AS (SELECT conv_id, [{{'f': 'system', 'v': 'S'}}] || list_transform(t[2:], lambda x: {{'f': x.f, 'v': trim(x.v)}}) AS t FROM n) SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM u")
def tagged_transcript(spark, sf_dir):
    tags = {"human": ("<u>", "</u>"), "gpt": ("<a>", "</a>"), "system": ("<s>", "</s>")}
    letter = lambda t: map_role(t["from"], {"human": "u", "gpt": "a", "system": "s"})
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("<"), letter(t), F.lit(">"), t["value"], F.lit("</"), letter(t), F.lit(">"))), "\n")
    return shown(clean(spark, sf_dir).withColumn("text", text).withColumn("turns", repair.tagged_turns("text", tags, system="S", first=1)))


@REG.query("json_fence_extract")
def json_fence_extract(spark, sf_dir):
    m = listed(spark, sf_dir).withColumn("raw", F.concat(F.lit("Sure:\n```json\n"), F.to_json("m"), F.lit("\n```")))
    return m.select("conv_id", F.length(repair.json_array("raw")).cast("long").alias("chars"))


# Counts, splits, order.

TOKENS = r"len(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_'']+|[^\p{{L}}\p{{N}}\p{{M}}_\s\p{{Z}}\x1C-\x1F\x85]'))"
COUNTED = f"WITH {CLEAN}, c AS (SELECT conv_id, {TOKENS.format('''array_to_string(list_transform(t, lambda x: x.v), chr(10))''')} AS n_tokens FROM n)"


def token_counts_of(spark, sf_dir) -> DataFrame:
    return clean(spark, sf_dir).select("conv_id", F.size(T.word_tokens(values_text("turns", "\n"))).cast("long").alias("n_tokens"))


@REG.query("token_counts", f"{COUNTED} SELECT conv_id, n_tokens FROM c")
def token_counts(spark, sf_dir):
    return token_counts_of(spark, sf_dir)


@REG.query("token_percentiles", f"{COUNTED} SELECT count(*) AS n, min(n_tokens) AS least, max(n_tokens) AS most, " + ", ".join(f"round(quantile_cont(n_tokens, {p}), 6) AS p{round(100 * p)}" for p in stats.POINTS) + " FROM c")
def token_percentiles(spark, sf_dir):
    return stats.percentiles(token_counts_of(spark, sf_dir), "n_tokens")


@REG.query("token_split", f"{COUNTED} SELECT conv_id, n_tokens, CASE WHEN n_tokens <= 600 THEN 'kept' ELSE 'long' END AS verdict FROM c")
def token_split(spark, sf_dir):
    return stats.split_by_limit(token_counts_of(spark, sf_dir), "n_tokens", 600)


@REG.query("longest_entry", f"{COUNTED} SELECT conv_id, n_tokens FROM c ORDER BY n_tokens DESC, conv_id LIMIT 1")
def longest_entry(spark, sf_dir):
    return stats.longest(token_counts_of(spark, sf_dir), "n_tokens", "conv_id")


def numbered_rows(spark, sf_dir) -> DataFrame:
    return reshape.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


POS = "p AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS _pos FROM conversations)"


@REG.query("split_parts", f"WITH {POS} SELECT conv_id, turn, CAST(_pos // 37 + 1 AS INTEGER) AS part FROM p")
def split_parts(spark, sf_dir):
    return reshape.split_parts(numbered_rows(spark, sf_dir), "_pos", 37).select("conv_id", "turn", "part")


@REG.query("line_range", f"WITH {POS} SELECT conv_id, turn, _pos + 1 >= 20 AS processed FROM p WHERE _pos + 1 <= 90")
def line_range(spark, sf_dir):
    return reshape.line_range(numbered_rows(spark, sf_dir), "_pos", 20, 90).select("conv_id", "turn", "processed")


@REG.query("shard_assignment", f"WITH {POS}, s AS (SELECT *, _pos // 50 AS shard, (SELECT max(_pos) // 50 + 1 FROM p) AS total FROM p) SELECT conv_id, turn, CAST(shard AS INTEGER) AS shard, printf('train-%05d-of-%05d.parquet', shard, total) AS file FROM s WHERE _pos % 7 <> 3")
def shard_assignment(spark, sf_dir):
    return reshape.shards(numbered_rows(spark, sf_dir), "_pos", 50).where("_pos % 7 <> 3").select("conv_id", "turn", "shard", "file")


@REG.query("merge_parts", "WITH f AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'y.jsonl' ELSE 'x_' || (conv_id % 12) || '.jsonl' END AS path FROM conversations), i AS (SELECT *, CASE WHEN path = 'y.jsonl' THEN 0 ELSE conv_id % 12 END AS k, conv_id * 100 + turn AS line FROM f) SELECT conv_id, turn, row_number() OVER (ORDER BY k, path, line) - 1 AS _pos FROM i")
def merge_parts(spark, sf_dir):
    path = F.when(F.col("conv_id") % 3 == 0, "y.jsonl").otherwise(F.concat(F.lit("x_"), (F.col("conv_id") % 12).cast("string"), F.lit(".jsonl")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", path.alias("path"), (F.col("conv_id") * 100 + F.col("turn")).alias("line"))
    return reshape.merge_order(rows, "path", "path", "line").select("conv_id", "turn", "_pos")


@REG.query("shuffle_seeded")
def shuffle_seeded(spark, sf_dir):
    return reshape.shuffled(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 5, "conv_id", "turn")


NUMBERS = "(conv_id % 8 = 5 AND i = 2)"


@REG.query("canonical_turns", f"WITH {BASE}, u AS (SELECT conv_id, list_transform(list_filter(t, lambda x, i: x.v IS NOT NULL AND NOT {NUMBERS}), lambda x: {{'f': x.f, 'v': {_strip('x.v')}}}) AS t FROM n) SELECT conv_id, len(t) AS n, {SAID.format('t')} AS said FROM u")
def canonical_turns(spark, sf_dir):
    """Values that aren't strings go, numbers too."""
    number = lambda i: (F.col("conv_id") % 8 == 5) & (i == 1)
    each = F.transform("turns", lambda t, i: F.when(number(i), F.concat(F.lit('{"from":"gpt","value":'), F.length(F.coalesce(t["value"], F.lit(""))).cast("string"), F.lit("}"))).otherwise(F.to_json(t, {"ignoreNullFields": "false"})))
    docs = defective(spark, sf_dir).select("conv_id", F.try_parse_json(F.concat(F.lit('{"conversations":['), F.array_join(each, ","), F.lit("]}"))).alias("_doc"))
    return shown(docs.withColumn("turns", formats.from_canonical(formats.as_turns(formats.pairs_at("_doc", "$.conversations", "from", "value")))))

"""Scalar text functions whose results follow Python's string methods rather than SQL's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1C-\x1F]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value written once in the plan and computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: Column | str) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(col(x), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def _capital(c: str) -> str:
    """Of one character for one: the capital, else the title letter, else the character itself."""
    return next((x for x in (c.upper(), c.title()) if len(x) == 1), c)


# Letters whose capitals are younger than Unicode 15, and the sharp s, whose capital no rule of Unicode's gives.
NEWER = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
KEPT_CAPITALS = {chr(c): _capital(chr(c)) for c in range(0x110000) if len(chr(c).upper()) > 1} | {c: c for c in NEWER} | {"ß": "ẞ"}


def capitals(x: Column | str) -> Column:
    """Upper case by one character for one, as DuckDB has it; Spark's own makes SS of a sharp s."""
    own = F.create_map(*(F.lit(s) for pair in KEPT_CAPITALS.items() for s in pair))
    each = F.transform(F.split(col(x), ""), lambda c: F.coalesce(F.try_element_at(own, c), F.upper(c)))
    return F.when(col(x).rlike("[" + "".join(KEPT_CAPITALS) + "]"), F.array_join(each, "")).otherwise(F.upper(col(x)))


def is_blank(x: Column | str) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(strip(x) == "", F.lit(True))


def collapse(x: Column | str) -> Column:
    """Stripped, with each run of white space as one space."""
    return strip(F.regexp_replace(col(x), rf"(?U){SPACE}+", " "))


def normalised(x: Column | str) -> Column:
    return F.lower(collapse(F.coalesce(col(x), F.lit(""))))


def ends_open(x: Column | str) -> Column:
    """The stripped text ends with a letter or digit of ASCII, or a comma."""
    return F.coalesce(strip(x).rlike("[a-zA-Z0-9,]$"), F.lit(False))


def ascii_scrub(x: Column | str) -> Column:
    """Only printable ASCII stays."""
    return F.regexp_replace(col(x), r"[^\x20-\x7E]", "")


# The ranges of letters that count as unwanted.
UNWANTED_RANGES = [
    (0x00C0, 0x017F), (0x0400, 0x04FF), (0x0370, 0x03FF), (0x0590, 0x05FF),
    (0x0600, 0x06FF), (0x0900, 0x097F), (0x4E00, 0x9FFF),
]
UNWANTED_CLASS = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in UNWANTED_RANGES) + "]"


def has_unwanted_unicode(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(UNWANTED_CLASS), F.lit(False))


def without_tags(x: Column | str) -> Column:
    """Markup tags as spaces, lower case, white space collapsed."""
    return F.lower(collapse(F.regexp_replace(col(x), "(?s)<.*?>", " ")))


def contains_any(x: Column | str, terms: Sequence[str]) -> Column:
    """Holds one of the terms (literals of the plan; see operators.joins.contains_join for long lists)."""
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(col(x), F.lit(t))
    return F.coalesce(found, F.lit(False))


def count_phrases(x: Column | str, phrases: Sequence[str]) -> Column:
    """How many of the distinct phrases occur, case-sensitively."""
    total = F.lit(0)
    for p in dict.fromkeys(phrases):
        total = total + F.coalesce(F.contains(col(x), F.lit(p)).cast("int"), F.lit(0))
    return total


def mime_type(path: Column | str) -> Column:
    """By extension; JPEG for unknown ones."""
    low = F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))
    # Extensions and their types.
    kinds = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
    out = F.lit("image/jpeg")
    for k, v in kinds.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def image_extension(url: Column | str) -> Column:
    """The url's image extension, or .jpg."""
    bare = F.regexp_replace(col(url), r"[?#].*$", "")
    low = F.lower(F.regexp_extract(bare, r"(\.[A-Za-z0-9]+)$", 1))
    return F.when(low.isin(".jpg", ".jpeg", ".png", ".webp", ".gif"), low).otherwise(".jpg")


def common_subsequence(text: Column | str, word: str) -> Column:
    """The length of the longest common subsequence of a text and a fixed short word: one row of the table, kept as an array
    while the text's characters go by."""
    each = F.filter(F.split(col(text), ""), lambda c: c != "")
    n = len(word)

    def step(row: Column, c: Column) -> Column:
        out = [F.lit(0)]
        for k in range(1, n + 1):
            out.append(F.when(c == word[k - 1], F.get(row, F.lit(k - 1)) + 1).otherwise(F.greatest(F.get(row, F.lit(k)), out[-1])))
        return F.array(*out)

    return F.aggregate(each, F.array(*[F.lit(0)] * (n + 1)), step, lambda row: F.get(row, F.lit(n)))


def fuzzy_ratio(text: Column | str, word: str) -> Column:
    """0 to 100: twice the longest common subsequence against the joint length, i.e. what insertions and deletions leave.
    Texts over three times as long as the word can't reach 50 and count as 0."""
    joint = F.length(col(text)) + len(word)
    return F.when(F.length(col(text)) > 3 * len(word), 0).otherwise(F.round(200 * common_subsequence(text, word) / joint).cast("int"))


def word_tokens(x: Column | str, punctuation: bool = True) -> Column:
    """Lower-case tokens: runs of word characters and apostrophes and, if asked for, single punctuation marks."""
    words = r"(?U)[\w']+|[^\w\s]" if punctuation else r"(?U)\b[\w']+\b"
    return F.regexp_extract_all(F.lower(col(x)), F.lit(words), F.lit(0))


def sentences(x: Column | str) -> Column:
    """Cut behind . ! or ? and white space; blank ones are dropped."""
    return F.filter(F.split(col(x), r"(?U)(?<=[.!?])\s+"), lambda s: strip(s) != "")

"""Conversations as ordered arrays of turns, struct<from, value>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.text import col

TURN = "struct<`from`:string,value:string>"
TURNS = f"array<{TURN}>"
# Role names and what they become.
CANONICAL = {"user": "human", "assistant": "gpt"}
MESSAGE = {"human": "user", "gpt": "assistant"}


def turn(who: Column | str, value: Column) -> Column:
    return F.struct((F.lit(who) if isinstance(who, str) else who).cast("string").alias("from"), value.cast("string").alias("value"))


def map_role(role: Column, names: dict[str, str]) -> Column:
    out = role
    for a, b in names.items():
        out = F.when(role == a, F.lit(b)).otherwise(out)
    return out


def nest(df: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id and turns of a table with a row for each turn."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(role_col).alias("r"), F.col(text_col).alias("v"))))
    whole = df.groupBy(id_col).agg(rows.alias("rows"))
    return whole.select(id_col, F.transform("rows", lambda x: turn(map_role(x["r"], CANONICAL), x["v"])).alias("turns"))


def flatten(df: DataFrame, id_col: str = "conv_id", turns_col: str = "turns") -> DataFrame:
    """A row for each turn: id, turn, from, value."""
    return df.select(id_col, F.posexplode(turns_col).alias("turn", "t")).select(id_col, "turn", F.col("t.from").alias("from"), F.col("t.value").alias("value"))


def values_text(turns: Column | str = "turns", between: str = "") -> Column:
    """All values that aren't null, joined."""
    return F.array_join(F.transform(col(turns), lambda t: t["value"]), between)


def of_role(role: str, turns: Column | str = "turns") -> Column:
    return F.filter(col(turns), lambda t: t["from"] == role)


def digest(turns: Column | str = "turns") -> Column:
    """SHA-256 of roles and values, for comparisons."""
    said = F.transform(col(turns), lambda t: F.concat(F.coalesce(t["from"], F.lit("<null>")), F.lit(":"), F.coalesce(t["value"], F.lit("<null>"))))
    return F.sha2(F.array_join(said, "\n"), 256)

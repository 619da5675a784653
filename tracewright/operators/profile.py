"""Profiles of tables, and starter packs of scenarios made from them.

A table is read once for the nulls and distinct sketches of all its columns.
Only columns whose sketch allows it are then checked exactly for being a key, by
counts per value that stop at the first value that repeats. What reaches the
driver is a row for each column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative error of the sketches, and the share of distinct values that makes a column worth an exact check.
RSD, MAYBE = 0.02, 0.8
INTEGERS, NUMBERS = ("tinyint", "smallint", "int", "bigint"), ("float", "double", "decimal")
# Parts of names that tell a column of states.
STATES = ("status", "state", "stage", "phase", "priority", "kind", "type")
#: What an update sets a text to.
DONE = "done"


def kind_of(dtype: str) -> str:
    return "integer" if dtype in INTEGERS else "number" if dtype.startswith(NUMBERS) else "text" if dtype == "string" else "time" if dtype.startswith(("date", "timestamp")) else "other"


def profile(df: DataFrame) -> list[dict]:
    """``column, kind, rows, nulls, is_key`` of every column in order; a key has no nulls and no value twice, and an empty table has none."""
    kinds = [(c, kind_of(t)) for c, t in df.dtypes]
    plain = [c for c, k in kinds if k != "other"]
    aggs = [F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"set_{i}") for i, (c, _) in enumerate(kinds)), *(F.approx_count_distinct(F.col(f"`{c}`"), RSD).alias(f"kinds_{c}") for c in plain)]
    seen = df.agg(*aggs).first()
    out = []
    for i, (c, k) in enumerate(kinds):
        maybe = c in plain and seen["n"] and seen[f"set_{i}"] == seen["n"] and seen[f"kinds_{c}"] >= MAYBE * seen["n"]
        key = bool(maybe) and df.groupBy(F.col(f"`{c}`")).agg(F.count("*").alias("times")).filter("times > 1").isEmpty()
        out.append({"column": c, "kind": k, "rows": seen["n"], "nulls": seen["n"] - seen[f"set_{i}"], "is_key": key})
    return out


def pack_columns(found: list[dict]) -> tuple[str, str] | None:
    """The integer key and the text column that a pack works on: no key itself, one of states if there is one; None where a table lacks either."""
    keys = [c["column"] for c in found if c["kind"] == "integer" and c["is_key"]]
    texts = [c["column"] for c in found if c["kind"] == "text" and not c["is_key"]]
    states = [c for c in texts if any(s in c.lower() for s in STATES)]
    return (keys[0], (states or texts)[0]) if keys and texts else None


def pack(df: DataFrame, name: str, columns: tuple[str, str]) -> DataFrame:
    """Scenarios over a table as rows ``scenario_id, task, key, value, expected``: set one row's text, and count the rows of its text.

    They are about the row of the least key with a text. ``expected`` is what
    the table has to show afterwards: the new text, or the number of rows. Doing
    nothing fails the update, since the row's text isn't what it is set to.
    """
    key, text = (F.col(f"`{c}`") for c in columns)
    row = df.filter(text.isNotNull() & (text != DONE)).agg(F.min(F.struct(key.cast("long").alias("key"), text.alias("value"))).alias("r")).select("r.*").filter("key is not null")
    same = df.select(text.alias("value")).join(row.select("value"), "value", "left_semi").agg(F.count("*").cast("string").alias("n"))
    update = row.select(F.lit(f"{name}/update").alias("scenario_id"), F.concat(F.lit(f"Set {columns[1]} of the row of {name} with {columns[0]} "), F.col("key").cast("string"), F.lit(f" to {DONE}.")).alias("task"), "key", "value", F.lit(DONE).alias("expected"))
    count = row.join(same).select(F.lit(f"{name}/count").alias("scenario_id"), F.concat(F.lit(f"How many rows of {name} have the {columns[1]} "), F.col("value"), F.lit("?")).alias("task"), "key", "value", F.col("n").alias("expected"))
    return update.unionByName(count)


def packs(tables: dict[str, DataFrame]) -> DataFrame:
    """The scenarios of all tables that a pack can be made of."""
    made = [(name, df, pack_columns(profile(df))) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, [pack(df, name, columns) for name, df, columns in made if columns])

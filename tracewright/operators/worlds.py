"""Worlds that agents act on: SQL checks, copy-on-write changes, state differences and scripted rollouts.

Declarative changes are DataFrames over the unchanged table. Arbitrary
statements of an agent run in an SQLite world of their own, one for each row of
a scenario, built and closed inside the Python worker.
"""

from __future__ import annotations

import json
import sqlite3
from contextlib import closing
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sandbox import code_holds

#: Rows of a SELECT that an agent is shown.
SHOWN_ROWS = 50


@dataclass(frozen=True)
class SqlCheck:
    """A query on the end state: its rows equal a list, their text contains something, there are any."""

    name: str
    query: str
    equals: list | None = None
    contains: str | None = None
    non_empty: bool | None = None


def judged_rows(check: SqlCheck, rows: list[list]) -> bool:
    """All conditions that the check names hold."""
    if check.equals is not None and rows != [list(r) for r in check.equals]:
        return False
    if check.contains is not None and check.contains not in str(rows):
        return False
    return not (check.non_empty is not None and bool(rows) != check.non_empty)


def holds(spark: SparkSession, check: SqlCheck) -> bool:
    """A check on the session's views; a query that fails fails the check.

    ``equals`` reads one row more than it expects. ``contains`` is looked for in
    the values of every row, on the executors.
    """
    try:
        found = spark.sql(check.query)
        if check.equals is not None and [list(r) for r in found.limit(len(check.equals) + 1).collect()] != [list(r) for r in check.equals]:
            return False
        if check.contains is not None:
            texts = F.concat_ws(", ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in found.columns))
            if found.filter(texts.contains(check.contains)).isEmpty():
                return False
        return check.non_empty is None or found.isEmpty() != check.non_empty
    except PySparkException:
        return False


def updated(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE: a null condition changes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    """DELETE: rows whose condition is null stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def state_diff(before: DataFrame, after: DataFrame, key: str, unchanged: bool = False) -> DataFrame:
    """``key, change, columns`` (those that differ) by a full join on the primary key."""
    others = [c for c in before.columns if c != key]
    b, a = before.select(F.col(key), F.struct(*others).alias("_b")), after.select(F.col(key), F.struct(*others).alias("_a"))
    both = b.join(a, key, "full_outer")
    differing = F.filter(F.array(*(F.when(~F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}")), c) for c in others)), lambda c: c.isNotNull())
    change = F.when(F.col("_b").isNull(), "inserted").when(F.col("_a").isNull(), "deleted").when(F.size(differing) > 0, "updated").otherwise("unchanged")
    found = both.select(key, change.alias("change"), F.when(change == "updated", differing).otherwise(F.array().cast("array<string>")).alias("columns"))
    return found if unchanged else found.filter("change != 'unchanged'")


def quoted(value: Any) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def text_table(columns: list[str], rows: list[tuple]) -> str:
    """Rows as a text table with a count below."""

    def cell(value: Any) -> str:
        return "None" if value is None else f"{value:g}" if isinstance(value, float) else str(value)

    if not columns:
        return "(no result)"
    return "\n".join([" | ".join(columns), *(" | ".join(map(cell, r)) for r in rows), f"({len(rows)} row{'s' * (len(rows) != 1)})"])


class SqliteWorld:
    """One SQLite world; statements that read only may be all that is allowed."""

    def __init__(self, schema: str, rows: list[list] | None = None, table: str | None = None, read_only: bool = False):
        self.db, self.read_only = sqlite3.connect(":memory:"), read_only
        self.db.executescript(schema)
        if rows:
            self.db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)

    def execute(self, query: str) -> str:
        """What an agent sees of a statement; errors come back as text."""
        head = (query.strip().split(None, 1) or [""])[0].lower()
        reads = head in ("select", "with")
        if self.read_only and not reads:
            return "SQLError: only SELECT statements are allowed"
        try:
            self.db.execute(f"PRAGMA query_only = {int(self.read_only)}")
            cursor = self.db.execute(query)
            if cursor.description is not None:
                return text_table([d[0] for d in cursor.description], cursor.fetchmany(SHOWN_ROWS))
            self.db.commit()
            return f"OK: {cursor.rowcount} row(s) affected"
        except (sqlite3.Error, sqlite3.Warning) as error:
            return f"SQLError: {error}"

    def rows(self, query: str) -> list[list]:
        return [list(r) for r in self.db.execute(query)]

    def close(self) -> None:
        self.db.close()


#: Rows of scenarios: the world, the actions of a policy on it, and the checks.
SCENARIOS = "scenario_id string, task string, schema string, table string, rows string, actions string, answer string, checks string"
RUNS = "scenario_id string, passed boolean, outcome double, steps int, observations string, failed string"


def played(schema: str, rows: list, table: str | None, actions: list[str], answer: str, checks: list[dict], allow_code: bool = False) -> dict[str, Any]:
    """One scripted rollout: run the actions, then check the end state and the answer; code checks hold only if running code is allowed."""
    with closing(SqliteWorld(schema, rows, table)) as world:
        seen = [world.execute(a) for a in actions]
        failed = []
        for check in checks:
            if check.get("kind", "sql") == "sql":
                try:
                    one = SqlCheck(check["name"], check["query"], check.get("equals"), check.get("contains"), check.get("non_empty"))
                    ok = judged_rows(one, world.rows(check["query"]))
                except sqlite3.Error:
                    ok = False
            elif check["kind"] == "called_tool":
                ok = check.get("tool", "sql_query") in (("sql_query",) if actions else ())
            elif check["kind"] == "code":
                ok = allow_code and code_holds(answer or "", check["test"])
            else:
                ok = any(x.lower() in (answer or "").lower() for x in check.get("any_of") or [])
            if not ok:
                failed.append(check["name"])
    share = round(1 - len(failed) / len(checks), 6) if checks else 1.0
    return {"passed": share >= 1.0, "outcome": share, "steps": len(actions), "observations": "\n".join(seen), "failed": ",".join(failed)}


def rollouts(scenarios: DataFrame) -> DataFrame:
    """Scripted rollouts of rows of ``SCENARIOS``, one world each."""

    def run(batches):
        for pdf in batches:
            out = [
                {"scenario_id": r.scenario_id, **played(r.schema, json.loads(r.rows or "[]"), r.table, json.loads(r.actions or "[]"), r.answer, json.loads(r.checks or "[]"))}
                for r in pdf.itertuples()
            ]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")])

    return scenarios.mapInPandas(run, RUNS)


#: Scripted adversaries that a sound scenario defeats: they do nothing, or say a constant or the task back, or only look.
ADVERSARIES = {"noop": ([], "done"), "constant": ([], "42"), "echo": ([], None), "echo_probe": (["SELECT name FROM sqlite_master"], None)}


def audited(scenarios: DataFrame) -> DataFrame:
    """Which adversaries pass each scenario, and whether it withstands them all."""
    each = [F.struct(F.lit(n).alias("adversary"), F.lit(json.dumps(a)).alias("actions"), (F.col("task") if text is None else F.lit(text)).alias("answer")) for n, (a, text) in ADVERSARIES.items()]
    crossed = scenarios.drop("actions", "answer").withColumn("a", F.explode(F.array(*each)))
    crossed = crossed.select(F.concat_ws("\x1f", "scenario_id", "a.adversary").alias("scenario_id"), "task", "schema", "table", "rows", "a.actions", "a.answer", "checks")
    runs = rollouts(crossed).select(F.split("scenario_id", "\x1f")[0].alias("scenario_id"), F.split("scenario_id", "\x1f")[1].alias("adversary"), "passed")
    beaten = F.array_sort(F.collect_list(F.when(F.col("passed"), F.col("adversary"))))
    return runs.groupBy("scenario_id").agg(beaten.alias("passed_by")).withColumn("robust", F.size("passed_by") == 0)

"""Verifiers and checkers that need no world, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .judge import acted_text, danger_hits
from .schema import VERIFICATION
from .steps import of_type, valid_calls


def check(name: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def tool_args() -> Column:
    calls = F.size(of_type("tool_call"))
    return check("tool_args", valid_calls() == calls, F.concat(valid_calls().cast("string"), F.lit(" of "), calls.cast("string"), F.lit(" calls are valid")))


def safe() -> Column:
    hits = danger_hits(acted_text())
    return check("safety", hits == 0, F.concat(hits.cast("string"), F.lit(" dangerous patterns")))


def expected_answer(expected: Column) -> Column:
    return check("expected_answer", F.lower(blank(F.col("final_answer"))).contains(F.lower(expected)), F.concat(F.lit("expected "), expected))


def called_tool(name: str, arguments: dict[str, str] | None = None, at_least: int = 1) -> Column:
    """Whether a tool was called often enough with the given argument values."""

    def right(s: Column) -> Column:
        ok = s["tool_name"] == name
        for key, value in (arguments or {}).items():
            ok = ok & F.get_json_object(s["tool_args"], f"$['{key}']").eqNullSafe(F.lit(value))
        return ok

    return F.size(F.filter(of_type("tool_call"), right)) >= at_least


def answer_contains(any_of: list[str], case_sensitive: bool = False) -> Column:
    answer = blank(F.col("final_answer"))
    text = answer if case_sensitive else F.lower(answer)
    out = F.lit(False)
    for wanted in any_of:
        out = out | text.contains(wanted if case_sensitive else wanted.lower())
    return out


def outcome(checks: list[Column]) -> Column:
    """Share of checks that hold; 1 without checks."""
    if not checks:
        return F.lit(1.0)
    total = F.lit(0)
    for one in checks:
        total = total + F.coalesce(one, F.lit(False)).cast("int")
    return F.round(total / F.lit(float(len(checks))), 6)


def verified(trajectories: DataFrame, expected: Column | None = None, extra: list[Column] | None = None, optional: tuple[str, ...] = ()) -> DataFrame:
    """``trajectories`` with their ``verification``: every check, the share that passed, and whether all required ones did."""
    checks = [tool_args(), safe(), *([expected_answer(expected)] if expected is not None else []), *(extra or [])]
    every = F.array(*checks)
    passed = F.size(F.filter(every, lambda c: c["passed"]))
    ok = F.forall(every, lambda c: c["passed"] | c["name"].isin(*optional)) if optional else F.forall(every, lambda c: c["passed"])
    made = F.struct(ok.alias("verified"), F.round(passed / F.lit(float(len(checks))), 3).alias("score"), every.alias("checks"), F.lit(None).cast("string").alias("detail"))
    return trajectories.withColumn("verification", made.cast(VERIFICATION))


def routed(probability: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """What the learned verifier settles by itself, and what a judge must see."""
    if not 0 <= low <= high <= 1:
        raise ValueError("0 <= low <= high <= 1 is needed")
    return F.when(probability < low, "auto_fail").when(probability >= high, "auto_pass").otherwise("needs_judge")


def answer_leaks(task: Column, any_of: Column) -> Column:
    """Expected answers that stand in the task as whole words, any case."""
    low = F.lower(blank(task))

    def leaks(token: Column) -> Column:
        return F.regexp_like(low, F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(F.lower(token), F.lit(r"\E"), F.lit("")), F.lit(r"\E(?!\w)")))

    return F.array_distinct(F.filter(any_of, leaks))

"""Code that must run: an isolated Python subprocess with a time limit. Off unless asked for; it is no security boundary."""

from __future__ import annotations

import subprocess
import sys

import pandas as pd
from pyspark.sql import DataFrame

#: What a test prints when it got to its end.
SENTINEL = "tracewright-test-passed"


def executed(code: str, seconds: float = 10.0) -> tuple[bool, str]:
    """Whether a script ended well, and its output or the last line of its error."""
    try:
        run = subprocess.run([sys.executable, "-I", "-c", code], capture_output=True, text=True, timeout=seconds, check=False)
    except subprocess.TimeoutExpired:
        return False, "Timeout"
    if run.returncode:
        return False, (run.stderr.strip().splitlines() or ["Error"])[-1]
    return True, run.stdout


def code_holds(code: str, test: str, seconds: float = 10.0) -> bool:
    """Whether a test that follows some code gets to its end."""
    ok, out = executed(f"{code}\n{test}\nprint({SENTINEL!r})", seconds)
    return ok and out.rstrip().endswith(SENTINEL)


def replayed(steps: DataFrame, allow: bool = False, seconds: float = 10.0) -> DataFrame:
    """``id, step_idx, same``: whether each code step of rows ``id, step_idx, code, code_output`` gives its output again."""
    if not allow:
        raise PermissionError("running recorded code has to be allowed")

    def run(batches):
        for pdf in batches:
            same = [executed(c or "", seconds)[1].strip() == (o or "").strip() for c, o in zip(pdf["code"], pdf["code_output"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "step_idx": pdf["step_idx"], "same": same})

    return steps.select("id", "step_idx", "code", "code_output").mapInPandas(run, "id string, step_idx int, same boolean")

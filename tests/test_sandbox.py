import pytest

from tracewright.operators import plugins, sandbox


def test_code_checks():
    assert sandbox.executed("print(1 + 1)") == (True, "2\n")
    assert sandbox.executed("raise ValueError('no')")[1] == "ValueError: no"
    assert sandbox.executed("while True: pass", seconds=0.5) == (False, "Timeout")
    assert sandbox.code_holds("def f(x): return x * 2", "assert f(2) == 4") and not sandbox.code_holds("def f(x): return x", "assert f(2) == 4")


def test_replay_has_to_be_allowed(spark):
    rows = spark.createDataFrame([("a", 0, "print(3)", "3"), ("a", 1, "print(3)", "4")], "id string, step_idx int, code string, code_output string")
    with pytest.raises(PermissionError):
        sandbox.replayed(rows)
    assert [r["same"] for r in sandbox.replayed(rows, allow=True).orderBy("step_idx").collect()] == [True, False]


def test_plugins():
    plugins.register("world", "box", lambda size=1: ("box", size))
    assert plugins.create("world", "box", size=3) == ("box", 3) and "box" in plugins.names("world")
    with pytest.raises(KeyError):
        plugins.create("world", "none")

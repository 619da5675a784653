"""Siblings, demonstrations, episodes, recipes, cards and streams on small fixtures."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import demonstrations, episodes, generation, rewards, siblings, worlds
from tracewright.operators import steps as step_operators
from tracewright.operators.schema import STEP_FIELDS, trajectory_schema
from tracewright.plans import catalog
from tracewright.sources import cards
from tracewright.streaming import resumable as streams

SCHEMA = "CREATE TABLE orders (id INTEGER PRIMARY KEY, status TEXT, note TEXT)"
ROWS = [[1, "open", "ann@example.com"], [2, "open", "big-box"], [3, "done", "12.50"], [4, "done", "x"]]


def demo(*actions):
    return {"task": "Close the orders.", "schema": SCHEMA, "rows": ROWS, "actions": list(actions), "answer": "closed"}


def test_siblings_keep_shapes_and_numbers(spark):
    cells = spark.createDataFrame([("s", r, c, x) for r, row in enumerate(ROWS) for c, x in enumerate(row) if isinstance(x, str)] + [("m", 0, 0, "1.5")], "scenario_id string, row int, col int, text string")
    texts = spark.createDataFrame([("s", "task", "mail ann@example.com about big-box"), ("s", "answer", "see big-box"), ("s", "equals", "done"), ("m", "task", "t")], "scenario_id string, place string, text string")
    names = {r["label"]: r["new"] for r in siblings.label_map(cells, F.lit(3)).collect()}
    assert names == {"open": "nepo3", "ann@example.com": "nna4@example.com", "big-box": "gib-box5", "done": "enod6"}
    new_cells, new_texts = siblings.held_out(cells, texts, F.lit(3))
    got = {(r["row"], r["col"]): r["text"] for r in new_cells.collect() if r["scenario_id"] == "s"}
    assert got[2, 1] == names["done"] and got[2, 2] == "12.50" and got[3, 2] == "x"
    assert {(r["sibling_id"], r["place"], r["text"]) for r in new_texts.collect()} == {("s~sibling", "task", "mail nna4@example.com about gib-box5"), ("s~sibling", "answer", "see gib-box5"), ("s~sibling", "equals", "enod6"), ("m", "task", "t")}


def made(spark, *demos):
    rows = [(f"demo{k}", d["task"], d["schema"], None, json.dumps(d["rows"]), json.dumps(d["actions"]), d["answer"], None) for k, d in enumerate(demos)]
    return sorted(demonstrations.scenarios(spark.createDataFrame(rows, demonstrations.DEMOS)).collect(), key=lambda r: r["scenario_id"])


def test_demonstrations_assert_the_change(spark):
    actions = ["UPDATE orders SET status = 'closed' WHERE id = 1", "DELETE FROM orders WHERE id = 4", "INSERT INTO orders VALUES (9, 'new', NULL)"]
    good, idle, bad, plain = made(spark, demo(*actions), demo("SELECT * FROM orders"), demo("UPDATE nothing SET a = 1"), {**demo("INSERT INTO log VALUES ('a \"b\"')"), "schema": SCHEMA + "; CREATE TABLE log (t TEXT)"})
    s = demonstrations.scenario_of(good)
    queries = [c["query"] for c in s["checkers"]]
    assert any("id=1" in q for q in queries) and any("COUNT(*)" in q and "id=4" in q for q in queries) and any("id=9" in q for q in queries) and any("id=2" in q for q in queries)
    env = s["environment"]
    assert worlds.played(env["schema"], env["rows"], env["table"], actions, "", s["checkers"])["passed"]
    assert not worlds.played(env["schema"], env["rows"], env["table"], [], "", s["checkers"])["passed"]
    assert demonstrations.gates([s], {"demo0": actions}) == ["fewer than 3 scenarios"]
    for row in (idle, bad):
        with pytest.raises(ValueError):
            demonstrations.scenario_of(row)
    assert demonstrations.scenario_of(plain)["checkers"][0]["equals"] == [['a "b"']]


def test_row_checks_are_bounded(spark):
    rows = [[k, "open", ""] for k in range(40)]
    (row,) = made(spark, {**demo("UPDATE orders SET status = 'c' WHERE id < 30"), "rows": rows})
    s = demonstrations.scenario_of(row)
    assert sum(c["query"].startswith("SELECT * FROM orders WHERE") for c in s["checkers"]) == demonstrations.MOST_ROW_CHECKS + 1


def test_read_only_worlds_and_check_kinds():
    world = worlds.SqliteWorld(SCHEMA, ROWS, "orders", read_only=True)
    assert world.execute("WITH x AS (SELECT 1) DELETE FROM orders").startswith("SQLError") and world.execute("SELECT count(*) FROM orders").endswith("4\n(1 row)")
    code = [{"kind": "code", "name": "c", "test": "assert f(2) == 4"}, {"kind": "called_tool", "name": "t"}]
    run = lambda answer, allow: worlds.played(SCHEMA, ROWS, "orders", ["SELECT 1"], answer, code, allow_code=allow)["failed"]
    assert run("def f(x): return 2 * x", True) == "" and run("def f(x): return x", True) == "c" and run("def f(x): return 2 * x", False) == "c"


def test_exported_arguments_are_objects(spark):
    from tracewright.sources import writers

    steps = [("tool_call", "search", json.dumps({"q": 'a "b" \n é', "n": [1, None]})), ("tool_call", "odd", "not json"), ("final_answer", None, None)]
    fields = dict.fromkeys(STEP_FIELDS)
    rows = [{f.name: None for f in trajectory_schema().fields}]
    rows[0].update(id="t", query="q", mode="single_agent", steps=[{**fields, "step_type": k, "tool_name": n, "tool_args": a} for k, n, a in steps], final_answer="done", tools=[])
    table = spark.createDataFrame(rows, trajectory_schema())
    line = json.loads(writers.jsonl(table).first()["value"])
    assert [s["tool_args"] for s in line["steps"]] == [{"q": 'a "b" \n é', "n": [1, None]}, "not json", None]
    assert line["messages"][1]["tool_calls"][0]["arguments"] == {"q": 'a "b" \n é', "n": [1, None]}
    text = table.select(step_operators.completion_text()).first()[0]
    assert text == 'Action: search({"q": "a \\"b\\" \\n \\u00e9", "n": [1, null]})\nAction: odd(not json)\nFinal answer: done'
    private = table.withColumn("steps", F.transform("steps", lambda s: s.withField("tool_args", F.lit('{"to": {"mail": "ann@example.com"}}')).withField("observation", F.lit("key sk-abcdefghijklmnop1234"))))
    line = json.loads(writers.jsonl(step_operators.redacted(private)).first()["value"])
    assert line["steps"][0]["tool_args"] == {"to": {"mail": "[redacted-email]"}} and line["steps"][0]["observation"] == "key [redacted-api_key]" and line["steps"][0]["tool_name"] == "search"
    call = json.loads(writers.adp(table).first()["steps"][0]["content"])
    assert call == {"tool": "search", "args": {"q": 'a "b" \n é', "n": [1, None]}}


def test_episodes():
    scenario = {"id": "e", "task": "t", "environment": {"schema": SCHEMA, "rows": ROWS, "table": "orders"}, "checkers": [{"query": "SELECT count(*) FROM orders WHERE status = 'open'", "equals": [[0]]}], "max_steps": 3}

    def good(seen, episode):
        return {"answer": "done"} if episode.steps else {"query": "UPDATE orders SET status = 'x' WHERE status = 'open'"}

    got = episodes.rollout(good, scenario)
    assert got["passed"] and got["reward"] == 1.0
    lost = episodes.rollout(lambda seen, e: {"query": "SELECT 1"}, scenario)
    assert not lost["passed"] and lost["steps"] == 3 and lost["answer"] == ""
    idle = episodes.rollout(lambda seen, e: {"answer": "x"}, scenario)
    assert idle["reward"] == 0.0
    bad = episodes.rollout(lambda seen, e: {"what": 1}, scenario)
    assert bad["reward"] < 0
    talk = episodes.conversation(lambda seen, e: good(seen, e) if not e.steps else {"answer": "ok"}, scenario, ["please", "thanks"])
    assert talk["passed"] and talk["replies"] == ["ok", "ok"]


def test_rewards(spark):
    tools = F.array(F.struct(F.lit("a").alias("name"), F.array(F.lit("x")).alias("required")), F.struct(F.lit("a").alias("name"), F.array().cast("array<string>").alias("required")))
    texts = {'{"tool": "a", "args": {"x": 1}}': 1.0, 'so: {"tool_name": "a", "arguments": {}}': round(2 / 3, 6), '{"tool": "b", "args": {}}': round(1 / 3, 6), "nothing": 0.0, '{"tool": "a"}': round(1 / 3, 6), '```json\n{"tool": "a", "args": {"x": null}}\n```': round(2 / 3, 6)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["r"] for r in rows.select("t", rewards.completion_reward(F.col("t"), tools).alias("r")).collect()} == texts


def test_recipe_removes_repeats(spark):
    queries = spark.createDataFrame([(0, "how long is the river"), (1, "how long is the river")], "ord long, query string")
    out = generation.run_recipe(spark, generation.Recipe("r", modes=("single_agent",)), queries)
    row = out["metrics"].first()
    assert row["num_trajectories"] + row["duplicates_removed"] == 2 and row["verified_rate"] == 1.0
    assert out["evals"].count() == row["num_trajectories"]
    assert catalog.queries()["recipe_metrics"](spark, "/root/testdata/sf0.001").first()["num_trajectories"] > 0


def test_recipe_metrics_use_every_item(spark):
    data = "/root/testdata/sf0.1"
    row = catalog.queries()["recipe_metrics"](spark, data).first()
    assert row["num_trajectories"] + row["duplicates_removed"] == 2 * spark.read.parquet(f"{data}/benchmark.parquet").count() > 80


def test_cards(spark, tmp_path):
    queries = spark.createDataFrame([(0, "a b c")], "ord long, query string")
    rows = generation.generated(generation.planned(queries, 3, ("single_agent",)), generation.Recipe("r"))
    text = cards.prepare_folder(rows, str(tmp_path / "set"), "demo")
    assert "n<1K" in text and spark.read.text(str(tmp_path / "set/train")).count() == 3
    assert [cards.size_bucket(n) for n in (0, 999, 1000, 99_999, 10**6)] == ["n<1K", "n<1K", "1K<n<10K", "10K<n<100K", "100K<n<1M"]
    assert cards.markdown(spark.createDataFrame([(1, None)], "a long, b string")) == "| a | b |\n|---|---|\n| 1 |  |\n"


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    base = str(tmp_path)
    spark.range(4).write.parquet(f"{base}/plan")
    args = (spark, f"{base}/plan", "id bigint", lambda df: df.withColumn("x", F.lit(1)), f"{base}/out", f"{base}/check")
    assert streams.resumable(*args) == 1
    assert streams.resumable(*args) == 0
    spark.range(4, 6).write.mode("append").parquet(f"{base}/plan")
    streams.resumable(*args)
    assert sorted(r["id"] for r in spark.read.parquet(f"{base}/out").collect()) == list(range(6))


def test_streaming_rate_limit(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(minutes=m)) for m in (0, 10, 20, 59, 60, 130)] + [("b", start)]
    spark.createDataFrame(rows, "ip string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ip string, ts timestamp").parquet(f"{tmp_path}/in")
    query = streams.rate_limited(stream, "ip", "ts", most=3).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r["recent"], r["rejected"]) for r in spark.table("limited").filter("ip = 'a'").orderBy("ts").collect()]
    assert got == [(1, False), (2, False), (3, False), (4, True), (4, True), (1, False)]


def test_lines_keep_their_order(spark, tmp_path):
    from tracewright.sources import readers

    lines = [json.dumps({"id": str(k), "query": f"q{k % 3}"}) for k in range(50)] + ["", json.dumps({"id": "0", "query": "q0"})]
    (tmp_path / "lines.jsonl").write_text("\n".join(lines))
    got = readers.trajectories_jsonl(spark, str(tmp_path / "lines.jsonl")).orderBy("ord").collect()
    assert [r["id"] for r in got] == [*map(str, range(50)), "0"] and len({r["ord"] for r in got}) == 51


def test_first_user_turn_is_the_query(spark):
    from tracewright.sources import readers

    q = spark.createDataFrame([(json.dumps({"id": "a", "question": [[{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]], "function": []}),)], "value string")
    a = spark.createDataFrame([(json.dumps({"id": "a", "ground_truth": [{"f": {"x": ["1"]}}]}),)], "value string")
    assert readers.bfcl_cases(q, a).first()["query"] == "u"

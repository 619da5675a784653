"""Cases of the findings of the third round."""

import functools
import operator
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions.stats import mean_reaches
from tracewright.operators import overlap, similarity
from tracewright.plans import catalog


def table_at(spark, path, name, df):
    df.coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_judge_scores_round_as_their_sql_does(spark, duck, tmp_path):
    """Lengths whose score lies between two places in binary and on the half in decimals (0.145, 0.285, 0.565, 0.575)."""
    n = F.col("id")
    table_at(spark, tmp_path, "documents", spark.range(2001).select(n.alias("doc_id"), F.lit("").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), n.alias("n_chars")))
    table_at(spark, tmp_path, "labels", spark.range(2001).select(n.alias("doc_id"), F.lit(1).cast("int").alias("quality"), F.lit(0).cast("int").alias("toxic")))
    got = {tuple(r) for r in catalog.queries()["judge_failures_unpivot"](spark, str(tmp_path)).collect()}
    con = duck.cursor()
    con.execute("CREATE SCHEMA f1")
    con.execute("USE f1")
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    wanted = set(con.execute(catalog.oracles()["judge_failures_unpivot"]).fetchall())
    assert len(wanted) > 1000
    assert got == wanted


def test_a_mean_on_the_threshold_does_not_hang_on_the_order(spark, tmp_path):
    """Two-place values whose mean is exactly 50: their sum in doubles is under it in some orders."""
    rng = random.Random(5)
    cents = [rng.randrange(1, 9_000) for _ in range(20)]
    cents += [10_000 - c for c in cents]
    orders = [rng.sample(cents, len(cents)) for _ in range(50)]
    assert any(functools.reduce(operator.add, (c / 100 for c in o)) < 2_000 for o in orders)
    rows = [(k, c / 100) for k, o in enumerate(orders) for c in o]
    events = [(2 * at, k, v) for at, (k, v) in enumerate(rows)] + [(2 * k + 1, k, 60.0) for k in range(len(orders))]
    table_at(spark, tmp_path, "events", spark.createDataFrame(events, "event_id long, user_id long, value double").withColumn("event_type", F.lit("view")).coalesce(1))
    assert catalog.queries()["run_diff"](spark, str(tmp_path)).collect() == []  # all pass in both runs


def test_means_of_other_values(spark):
    groups = {"nan": [1.0, float("nan")], "infinite": [float("inf"), 1.0], "low": [49.99, 50.0], "null": [None, None], "part": [None, 50.0], "fine": [1 / 3, 1 / 3], "huge": [1e300, 1.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, value double")
    got = {r["k"]: r["ok"] for r in rows.groupBy("k").agg(mean_reaches(F.col("value"), 50).alias("ok")).collect()}
    assert got == {"nan": True, "infinite": True, "low": False, "null": None, "part": True, "fine": False, "huge": True}


def rows_kept(monkeypatch, module):
    """``label, columns, rows`` of every table that a module writes."""
    kept = []

    def counted(df, label, keep=module.stored):
        out = keep(df, label)
        kept.append((label, out.columns, out.count()))
        return out

    monkeypatch.setattr(module, "stored", counted)
    return kept


def sets_of(spark, texts, first=0):
    return similarity.shingled(spark.createDataFrame(list(enumerate(texts, first)), "ord long, text string"), F.col("ord"), F.col("text"))


def test_whole_sets_are_written_once(spark, monkeypatch):
    kept = rows_kept(monkeypatch, similarity)
    texts = [f"a{k} b{k} c{k} d{k} e{k} f{k}" for k in range(50)] + ["a7 b7 c7 d7 e7 f7", "a8 b8 c8 d8 e8 f8 g8"]
    stay, go = similarity.deduplicate(sets_of(spark, texts), 0.8)
    assert {r["ord"] for r in stay.collect()} == set(range(50)) and {(r["ord"], r["kept"], r["sim"]) for r in go.collect()} == {(50, 7, 1.0), (51, 8, 0.8)}
    assert [label for label, columns, _ in kept if "shingles" in columns] == ["sets"]


def test_overlap_writes_shared_members_only(spark, monkeypatch):
    kept = rows_kept(monkeypatch, overlap)
    others = [" ".join(f"{c}{k}" for c in "abcdefgh") for k in range(100)]
    got = {r["ord"]: r["overlap"] for r in overlap.best_overlap(sets_of(spark, ["a3 b3 c3 d3", "none of all"]), sets_of(spark, others)).collect()}
    assert got == pytest.approx({0: 2 / 6, 1: 0.0})
    assert all(n <= 10 for _, _, n in kept)

"""Cases of the findings of the fourth round, each of which failed before its change."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import similarity
from tracewright.plans import catalog


def tables_kept(monkeypatch):
    """Every table that the similarity operators write, by its label."""
    kept = {}

    def noted(df, label, keep=similarity.stored):
        kept.setdefault(label, []).append(keep(df, label))
        return kept[label][-1]

    monkeypatch.setattr(similarity, "stored", noted)
    return kept


def near_copies(rng, words, copies):
    """Texts that differ from one of that many words in up to a word in eighty, some of them longer by a tenth."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(max(2, words // 80))):
            text[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        yield " ".join(text + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(2) * words // 10)])


def sets_of(spark, texts):
    return similarity.shingled(spark.createDataFrame(list(enumerate(texts)), "ord long, text string"), F.col("ord"), F.col("text"))


def wanted(sets, threshold):
    """All pairs of first rows, by force."""
    first = {}
    for r in sorted(sets.collect(), key=lambda r: r["ord"]):
        first.setdefault(frozenset(r["shingles"]), r["ord"])
    found = {}
    for (x, i), (y, j) in itertools.combinations(first.items(), 2):
        if len(x & y) / max(len(x | y), 1) >= threshold:
            found[i, j] = len(x & y) / len(x | y)
    return found


@pytest.mark.parametrize("block", [similarity.BLOCK, 500])
@pytest.mark.parametrize("threshold", [0.85, 0.3])
def test_pairs_in_cells_are_all_pairs(spark, monkeypatch, block, threshold):
    """Sizes on both sides of a power of two, so sketches of several lengths meet; groups of one block and of many."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(3)
    texts = [t for words in (5, 64, 66, 130, 300) for t in near_copies(rng, words, 12)] + ["", ""]
    rng.shuffle(texts)
    sets = sets_of(spark, texts)
    all_pairs = wanted(sets, threshold)
    assert len(all_pairs) > 80
    assert {(r["i"], r["j"]): r["sim"] for r in similarity.similar_pairs(sets, threshold).collect()} == all_pairs


def test_a_set_is_sent_to_a_cell_not_to_each_of_its_pairs(spark, monkeypatch):
    kept = tables_kept(monkeypatch)
    rng = random.Random(4)
    copies = [f"{t} end" for t in near_copies(rng, 200, 30)]
    common = [" ".join(f"c{k}x{x}" for x in range(40)) for k in range(12)]
    others = [" ".join([*rng.sample(common, 5), " ".join(f"rare{k // 2}x{x}" for x in range(10))]) for k in range(40)]  # they meet, but are mostly far apart
    sets = sets_of(spark, copies + others)
    all_pairs = wanted(sets, 0.85)
    assert {(r["i"], r["j"]) for r in similarity.similar_pairs(sets, 0.85).collect()} == set(all_pairs)
    (met,), (near,), (cells,) = kept["met"], kept["near"], kept["cells"]
    assert met.filter("i >= 30").count() >= 20 and 4 * near.filter("i >= 30").count() < met.filter("i >= 30").count()
    rows = cells.filter("i < 30").select(F.explode(F.array("i", "j")).alias("ord"), "cell").distinct().count()
    assert rows <= len(copies) + 10 < len(all_pairs)


def test_run_diff_of_null_keys(spark, duck, tmp_path):
    """A row without a user or type is no scenario of the other half's, as in the SQL."""
    rows = [(0, None, "view", 60.0), (1, None, "view", 40.0), (2, 3, None, 60.0), (3, 3, None, 60.0), (4, 5, "view", None), (5, 5, "view", 70.0), (6, 6, "view", 70.0), (7, 6, "view", 7.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duck.cursor()
    con.execute("CREATE SCHEMA r04")
    con.execute("USE r04")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("run_diff", "run_diff_summary"):
        got = sorted((tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()), key=repr)
        assert got == sorted(con.execute(catalog.oracles()[name]).fetchall(), key=repr)


def test_deduplication_verifies_in_cells(spark, monkeypatch):
    """Every verification of leaders' links, open pairs and removed rows goes by sketches and cells; a removed row keeps its best match."""
    kept = tables_kept(monkeypatch)
    monkeypatch.setattr(similarity, "BLOCK", 1000)
    rng = random.Random(6)
    sets = sets_of(spark, [t for words in (64, 130, 200) for t in near_copies(rng, words, 10)])
    pairs = wanted(sets, 0.85)
    of = {o: min(p for p, q in [(r["ord"], frozenset(r["shingles"])) for r in sets.collect()] if q == s) for o, s in [(r["ord"], frozenset(r["shingles"])) for r in sets.collect()]}
    stay = []
    for o in sorted(set(of.values())):
        if not any((k, o) in pairs for k in stay):
            stay.append(o)
    best = {}
    for o, first in of.items():
        if first in stay:
            if o != first:
                best[o] = (first, 1.0)
        else:
            sim, other = max((pairs[min(k, first), max(k, first)], -k) for k in stay if k < o and (min(k, first), max(k, first)) in pairs)
            best[o] = (-other, round(sim, 3))
    left, gone = similarity.deduplicate(sets, 0.85)
    assert sorted(r["ord"] for r in left.collect()) == stay and len(best) > 10
    assert {r["ord"]: (r["kept"], r["sim"]) for r in gone.collect()} == best
    assert len(kept["cells"]) == len(kept["near"]) >= 3 and len(kept["sets"]) == 1

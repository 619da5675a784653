"""The vector forest, fill-in-the-middle rows and Merkle manifests: brute force and odd rows."""

import hashlib
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import embeddings, fim, merkle, queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_links(rows, cosine=0.9):
    """``n_links, component`` of each row (id, vector) by all pairs."""
    use = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    unit = {k: np.array(rows[k][1], dtype=float) / np.linalg.norm(np.array(rows[k][1], dtype=float)) for k in use}
    for a, i in enumerate(use):
        for j in use[a + 1 :]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                up[top(j)] = top(i)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[top(k)] = min(key, least.get(top(k), key))
    return [(rows[k][0], links[k], least.get(top(k))) for k in range(len(rows))]


def planted(seed=3, width=16):
    """Vectors with a hot group of near copies, chains, exact copies and noise."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(width) for _ in range(300)]
    base = rng.standard_normal(width)
    out += [base + 0.1 * rng.standard_normal(width) for _ in range(200)]
    out += [base + 0.35 * rng.standard_normal(width) for _ in range(60)]
    for k in range(20):
        near = rng.standard_normal(width)
        out += [near + 0.2 * rng.standard_normal(width) for _ in range(k % 5 + 1)]
    out += [out[5]] * 40 + [out[310]] * 3
    return [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(out)]


def found_links(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_forest_finds_planted_links(spark, monkeypatch, small):
    if small:  # many leaves, further rounds, leaves in blocks, centres from a part of the vectors
        for name, value in (("LEAF_ROWS", 16), ("LEAF_SAMPLE", 8), ("BLOCK_ROWS", 32), ("SAMPLE_NUMBERS", 16 * 300), ("MOST_TREES", 40), ("DEEPER", 2)):
            monkeypatch.setattr(embeddings, name, value)
    rows = planted()
    got = found_links(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    want = sorted(plain_links(rows), key=repr)
    if small:
        assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
        assert sum(a[1] for a in got) >= 0.9 * sum(b[1] for b in want)
    else:
        assert got == want


def test_forest_without_centres_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "HOT", 10**6)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 64)
    rows = planted(seed=4)
    assert found_links(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == sorted(plain_links(rows), key=repr)


def test_forest_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((20_000, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    trees = embeddings.forest(unit, np.full(len(unit), 32), 10**6, 0.9)
    assert 2 <= len(trees) < embeddings.MOST_TREES and trees[0][0] >= 8
    some = unit[-2000:]
    aside = rng.standard_normal(some.shape)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    other = 0.9 * some + np.sqrt(1 - 0.81) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    hit = np.zeros(2000, dtype=bool)
    for t, (depth, low, high) in enumerate(trees):
        ways = embeddings.directions((11, t), depth, 32)
        hit |= embeddings._shared(embeddings.routed(some, ways, depth, low, high), embeddings.routed(other, ways, depth, low, high), 1 << depth)[:2000]
    assert hit.mean() >= 0.95


ODD = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]),
    (None, [1.0, 0.01]), (None, [0.0, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 1e-300]), (11, [1e300, 1e300]), (12, [-1.0, 0.0]), (13, [1.0]),
]


def test_forest_odd_rows(spark):
    base = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("id", "node", "hot", "leaf", "copies", "n_links", "kept", "vector")})
    rows = [(k, v) for k, v in ODD]
    got = embeddings.near_duplicates(base).collect()
    want = plain_links([(k, [x / max(map(abs, v)) for x in v] if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else v) for k, v in rows])
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    alone = [r for r in got if r["vec_id"] is None and r["n_links"] == 0]
    assert [(r["component_id"], r["kept"]) for r in alone] == [(None, True)]
    empty = embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_op11_equals_all_pairs(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert found_links(queries.QUERIES["op11_projection_forest"](spark, data)) == sorted(plain_links(rows), key=repr)


# fill-in-the-middle

TEXTS = [None, "", "a", "one two", "x<P>y", "<M>", "a<S", "é 日本\n\t😀 ok <", "p<P q<S r<M>"[:-1], "word " * 30_000, "<", ">P<"]


def plain_fim(key, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_rows_equal_plain_ones_and_come_back(spark):
    rows = [(k * len(TEXTS) + i if k else None, t) for k in range(12) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_units", "_body", "n", "form", "output", "extra")})
    found = fim.transformed(docs)
    assert found.columns == ["doc_id", "text", "_units", "_body", "extra", *fim.RESULTS]
    got = found.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fim_sentinels_can_differ_and_must_not_overlap(spark):
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    docs = spark.createDataFrame([(k, "some words <P> here, <|pref") for k in range(40)], "doc_id long, text string")
    got = fim.transformed(docs, seed=7, sentinels=marks, percent=100, spm_percent=50)
    rows = got.select("form", "output", fim.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert {r["form"] for r in rows} == {"psm", "spm"} and all(r["back"] == "some words <P> here, <|pref" for r in rows)
    for bad in (("a", "a", "b"), ("ab", "ba", "c"), ("abc", "b", "d"), ("aXa", "q", "r"), ("a", "b", "")):
        with pytest.raises(ValueError):
            fim.transformed(docs, sentinels=bad)


# Merkle manifests


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves, fan):
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, p in enumerate(places):
            run, i = level[p // fan * fan : (p // fan + 1) * fan], p % fan
            paths[k].append((run[:i], run[i + 1 :]))
            places[k] = p // fan
        level = [digest(*level[a : a + fan]) for a in range(0, len(level), fan)]
    return level[0], paths


def plain_manifest(rows, columns, fan=16):
    """``key, leaf, subroot, root, proof, folded, verified`` of rows (dicts), a fifth of them tampered with."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], digest(*(framed(r[c]) for c in columns)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_tree([x[1] for x in groups[s]], fan)
    root, tops = plain_tree([trees[s][0] for s in order], fan)
    out = []
    for s, top in zip(order, tops, strict=True):
        for (key, own, r), path in zip(groups[s], trees[s][1], strict=True):
            f = own
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0:
                f = digest(*(framed(r[c].translate(LOWER) if c == "text" and r[c] is not None else r[c]) for c in columns))
            for left, right in path + top:
                f = digest(*left, f, *right)
            proof = "".join("".join(a) + "".join(b) for a, b in path + top)
            out.append((key, own, trees[s][0], root, proof, f, f == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def spark_manifest(docs, shape=None):
    def leaf(text):
        return merkle.leaf(*(F.col(c) for c in COLUMNS[:-1]), text)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(tampered, leaf(F.translate("text", string.ascii_uppercase, string.ascii_lowercase)))
    found = merkle.manifest(docs, "doc_id", "source", leaf(F.col("text")), claimed, shape or merkle.Shape())
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")) for r in found.collect()), key=repr)


@pytest.mark.parametrize("shape", [(16, 3), (3, 2), (2, 1)])
def test_manifest_equals_a_plain_tree(spark, shape):
    rows = [(k, ("hot" if k % 3 else f"s{k % 7}") if k % 11 else None, "en", k, f"Text {k} É Z") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert spark_manifest(docs, merkle.Shape(*shape)) == plain_manifest([r.asDict() for r in docs.collect()], COLUMNS, shape[0])


def test_manifest_many_groups_and_full_runs(spark):
    rows = [(k, f"g{k // 2}", None, None, None) for k in range(600)] + [(1000 + k, "full", "de", 1, "A") for k in range(256)] + [(5000 + k, "one more", "de", 1, "A") for k in range(257)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert spark_manifest(docs) == plain_manifest([r.asDict() for r in docs.collect()], COLUMNS)


def test_manifest_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "", 0, ""), (1, "", "", 0, ""), (1, "", "x", 0, "B"), (2, "-", "en", None, "Grüße 日本 \x00"), (3, "a", "en", 5, "LONG " * 100_000), (None, "a", None, None, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(c) for c in ("tree", "rank", "nodes", "hash", "bucket", "place", "key", "part", "root", "leaf")})
    assert spark_manifest(docs) == plain_manifest([dict(zip(COLUMNS, r, strict=True)) for r in rows], COLUMNS)
    empty = merkle.manifest(spark.createDataFrame([], "doc_id long, source string"), "doc_id", "source", merkle.leaf(F.col("doc_id")))
    assert empty.collect() == [] and empty.columns[:2] == ["doc_id", "source"]


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(4, "s")], "doc_id long, source string")
    (row,) = merkle.manifest(docs, "doc_id", "source", merkle.leaf(F.col("doc_id"))).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == digest("1:4") and row["proof"] == "" and row["verified"]

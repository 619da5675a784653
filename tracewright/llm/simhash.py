"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of whole texts are linked when at most ``radius`` bits differ, and
documents get the least id that links reach. Search over the distinct
fingerprints: correlated bits are grouped into m partitions; each fingerprint,
as a query, gets thresholds t_1..t_m (each at least -1) with sum
``radius - m + 1`` from a dynamic program over its estimated candidate counts,
so a partition whose value is common is probed narrowly or not at all. If two
fingerprints differ in at most ``radius`` bits, some partition differs in at
most its threshold, so no link is lost. Probes meet the index by key; a key
with very many fingerprints is dealt in blocks, its queries being repeated for
each block. Each task keeps a spanning forest of the links it verified, so what
is written grows with the fingerprints and not with the pairs.

Nulls and odd rows: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; a very long text is hashed whole, some
32,768 shingles at a time; of a bit that is set in exactly half of the shingles
the fingerprint has 0, and equal fingerprints are one node however many rows
have them; a null id never is a component id unless all ids of the component are
null; repeated rows stay; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .shared import discard, membership, unused, written

#: Fingerprints of one key that one task compares at a time.
BLOCK_ROWS = 16_384
#: Cost of shuffling one probe, in candidate comparisons.
PROBE_COST = 80.0
#: Texts of a Hamming component that all its texts are compared with.
PIVOTS = 2
#: Texts that one task compares with the same text, or that share a prefix shingle there, in the mean.
GROUP_TEXTS = 2048
#: Cells that shingles are counted in, to take the common ones last.
CELLS = 1 << 20
#: Candidates that are compared at a time.
_CHUNK = 1 << 18


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole UTF-8 text, as an unsigned number."""
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    if n <= shingle:
        return int.from_bytes(digest(b" ".join(words), seed), "big")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[shingle - 1 :].tolist()
    total, ones = len(ends), np.zeros(64, dtype=np.int64)
    for at in range(0, total, 1 << 15):
        some = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=False)])
        ones += np.unpackbits(np.frombuffer(some, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """A row of 64 bits (most significant first) for each fingerprint."""
    return np.unpackbits(np.ascontiguousarray(fps.view(np.uint64).astype(">u8")).view(np.uint8).reshape(-1, 8), axis=1)


def co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both; 4096 sums reach the driver."""

    def run(batches):
        both = np.zeros((64, 64))
        for batch in batches:
            b = bits_of(batch.column(0).to_numpy()).astype(np.float32)
            for at in range(0, len(b), 1 << 16):
                both += b[at : at + (1 << 16)].T @ b[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(both.astype(np.int64).ravel())], names=["cell", "n"])

    sums = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096)
    for r in sums:
        both[r["cell"]] = r["n"]
    return fps.count(), both.reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits of nearly equal size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    phi = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    left, groups = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        group = [max(sorted(left), key=lambda b: phi[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: phi[b, group].mean()))
            left.discard(group[-1])
        groups.append(group)
    return groups


def _values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def block_counts(fps: DataFrame, blocks: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each value in each block of at most 8 bits (bounded: 256 sums for each block)."""

    def run(batches):
        found = np.zeros((len(blocks), 256), dtype=np.int64)
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy())
            for k, block in enumerate(blocks):
                found[k] += np.bincount(_values(bits, block), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(found.size, dtype=np.int32)), pa.array(found.ravel())], names=["cell", "n"])

    out = np.zeros(len(blocks) * 256)
    for r in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(len(blocks), 256)


class Plan:
    """Partitions of the bits, and the estimates that thresholds are allocated by."""

    def __init__(self, n: int, groups: list[list[int]], counts: np.ndarray, radius: int):
        self.n, self.groups, self.radius = n, groups, radius
        self.total = radius - len(groups) + 1
        self.most = min(radius, self.total + len(groups) - 1)
        self.blocks = [[g[a : a + 8] for a in range(0, len(g), 8)] for g in groups]
        distance = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)])
        self.near, at = [], 0
        for blocks in self.blocks:
            rows = []
            for _ in blocks:
                share = counts[at] / max(n, 1)
                rows.append(np.stack([(distance == d) @ share for d in range(self.most + 1)], axis=1))
                at += 1
            self.near.append(rows)

    def expected(self, bits: np.ndarray, part: int) -> np.ndarray:
        """Estimated fingerprints within 0, 1, .. bits of each query in a partition, its blocks taken as independent."""
        at_distance = np.zeros((len(bits), self.most + 1))
        at_distance[:, 0] = 1.0
        for block, near in zip(self.blocks[part], self.near[part], strict=True):
            share, out = near[_values(bits, block)], np.zeros_like(at_distance)
            for d in range(self.most + 1):
                for e in range(self.most + 1 - d):
                    out[:, d + e] += at_distance[:, d] * share[:, e]
            at_distance = out
        return self.n * np.cumsum(at_distance, axis=1)

    def probes(self, part: int, threshold: int) -> int:
        return sum(comb(len(self.groups[part]), d) for d in range(threshold + 1))

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """For each query the thresholds of least estimated cost whose sum the principle asks for."""
        m, rows = len(self.groups), len(bits)
        span = self.total + m  # sums from -m to total, as 0..span
        best = np.full((span + 1, rows), np.inf)
        best[0] = 0.0
        picks = []
        for part in range(m):
            cost = self.expected(bits, part)
            new, pick = np.full_like(best, np.inf), np.zeros((span + 1, rows), dtype=np.int8)
            for t in range(-1, self.most + 1):
                price = 0.0 if t < 0 else cost[:, t] + PROBE_COST * self.probes(part, t)
                for s in range(span + 1 - (t + 1)):
                    total = best[s] + price
                    less = total < new[s + t + 1]
                    new[s + t + 1][less], pick[s + t + 1][less] = total[less], t
            best, _ = new, picks.append(pick)
        self.cost = float(best[span].mean()) if rows else 0.0
        out, state, each = np.zeros((rows, m), dtype=np.int8), np.full(rows, span), np.arange(rows)
        for part in reversed(range(m)):
            out[:, part] = picks[part][state, each]
            state = state - out[:, part] - 1
        return out


def make_plan(fps: DataFrame, radius: int) -> Plan:
    """The number of partitions with the least cost estimated from the counts, and the plan for it."""
    n, both = co_occurrence(fps)
    grouped = {m: grouped_bits(n, both, m) for m in range(2 if radius > 1 else 1, min(radius + 1, 16) + 1)}
    blocks = {m: [g[a : a + 8] for g in groups for a in range(0, len(g), 8)] for m, groups in grouped.items()}
    every = block_counts(fps, [b for m in grouped for b in blocks[m]])
    options, done = [], 0
    for m, groups in grouped.items():
        counts = every[done : done + len(blocks[m])]
        done += len(blocks[m])
        plan = Plan(n, groups, counts, radius)
        rng = np.random.default_rng(7)  # queries drawn from the counts, to price this m
        bits = np.zeros((512, 64), dtype=np.uint8)
        for block, found in zip(blocks[m], counts, strict=True):
            p = found + 1e-12
            values = rng.choice(256, size=512, p=p / p.sum())
            bits[:, block] = values[:, None] >> np.arange(len(block)) & 1
        plan.thresholds(bits)
        options.append((plan.cost, m, plan))
    return min(options, key=lambda x: x[:2])[2]


def probe_rows(plan: Plan, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index rows and probes of some fingerprints: key, side (0 index, 1 probe) and fingerprint."""
    bits = bits_of(fps)
    limits = plan.thresholds(bits)
    keys, sides, rows = [], [], []
    for part, group in enumerate(plan.groups):
        values = _values(bits, group)
        keys.append((part << 56) | (values << 24)), sides.append(np.zeros(len(fps), np.int8)), rows.append(fps)
        for d in range(plan.most + 1):
            some = limits[:, part] >= d
            if not some.any():
                continue
            v, f = values[some], fps[some]
            for flips in combinations(range(len(group)), d):
                mask = sum(1 << b for b in flips)
                keys.append((part << 56) | ((v ^ mask) << 24)), sides.append(np.ones(len(v), np.int8)), rows.append(f)
    return np.concatenate(keys), np.concatenate(sides), np.concatenate(rows)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: each node but the least of its component, and that least one."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _links(batches, radius: int):
    """Verified links of sorted index rows and probes, as a spanning forest. Memory: one block, one batch, the forest."""
    held_keys, held = np.empty(0, np.int64), np.empty(0, np.int64)
    node, root = np.empty(0, np.int64), np.empty(0, np.int64)
    new_a: list[np.ndarray] = []
    new_b: list[np.ndarray] = []
    waiting = 0

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, sides, fps = (batch.column(i).to_numpy() for i in range(3))
        index = sides == 0
        data_keys, data = np.concatenate([held_keys, keys[index]]), np.concatenate([held, fps[index]])
        query_keys, queries = keys[~index], fps[~index]
        low, high = np.searchsorted(data_keys, query_keys, "left"), np.searchsorted(data_keys, query_keys, "right")
        many = high - low
        ends = np.cumsum(many)
        at = 0
        while at < len(queries):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + _CHUNK, "right")))
            n = many[at:to]
            q = np.repeat(np.arange(at, to), n)
            x = np.arange(n.sum()) - np.repeat(ends[at:to] - n - done, n) + low[q]
            apart = np.bitwise_count((queries[q] ^ data[x]).view(np.uint64))  # of a signed number it would count the absolute value
            near = (apart <= radius) & (apart > 0)
            if near.any():
                a, b = forest(queries[q[near]], data[x[near]])
                new_a.append(a), new_b.append(b)
                waiting += len(a)
            if waiting > 500_000:
                node, root = forest(np.concatenate([node, *new_a]), np.concatenate([root, *new_b]))
                new_a, new_b, waiting = [], [], 0
                if len(node) > 2_000_000:
                    yield out(node, root)
                    node, root = node[:0], root[:0]
            at = to
        last = data_keys == keys[-1]
        held_keys, held = data_keys[last], data[last]
    if len(node) or new_a:
        node, root = forest(np.concatenate([node, *new_a]), np.concatenate([root, *new_b]))
    yield out(node, root)


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of distinct ``fp`` at most ``radius`` bits apart."""
    plan = make_plan(fps, radius)

    def spread(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for at in range(0, len(rows), 4096):
                key, side, fp = probe_rows(plan, rows[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(fp)], names=["key", "side", "fp"])

    rows = fps.select("fp").mapInArrow(spread, "key long, side byte, fp long")
    values = fps.select("fp").mapInArrow(lambda batches: _index_only(batches, plan), "key long")
    hot = written(values.groupBy("key").count().filter(F.col("count") > BLOCK_ROWS).withColumn("blocks", F.ceil(F.col("count") / BLOCK_ROWS)).drop("count"), "hot")
    if not hot.isEmpty():
        rows = rows.join(hot, "key", "left")
        block = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long")))
        block = block.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("fp"), "blocks")))
        block = block.otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        rows = rows.withColumn("block", F.explode(block)).select((F.col("key") + F.col("block")).alias("key"), "side", "fp")
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = rows.repartition(tasks, "key").sortWithinPartitions("key", "side")
    return met.mapInArrow(lambda batches: _links(batches, radius), "a long, b long").distinct()


def _index_only(batches, plan: Plan):
    for batch in batches:
        bits = bits_of(batch.column(0).to_numpy())
        for part, group in enumerate(plan.groups):
            yield pa.RecordBatch.from_arrays([pa.array((part << 56) | (_values(bits, group) << 24))], names=["key"])


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the least ``doc_id`` reached over links of at most
    ``radius`` differing bits, the row's own included.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints", texts=True)
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = written(links(distinct, radius), "links")
    roots = connected(edges)
    classes = distinct.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = written(classes.join(least, "root").select("fp", "component_id"), "classes")
    discard(edges, distinct, roots)
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (all words where it has fewer)."""
    words = text.lower().split()
    n, k = len(words), min(shingle, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    made = b"".join([digest(joined[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)])
    return np.unique(np.frombuffer(made, dtype=">u8").astype(np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``least``; two empty sets are equal."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both >= least * (len(a) + len(b) - both)


def pivot_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of texts ``component, _text, fp``: every text with the ``PIVOTS`` nearest to its component's majority of bits.

    Copies that were made from one text differ less from it than from each
    other, and its fingerprint is about the majority. Linear in the texts.
    """
    bits = [F.sum(F.getbit("fp", F.lit(k)).cast("long")).alias(f"b{k}") for k in range(64)]
    sums = members.groupBy("component").agg(F.count("*").alias("n"), *bits)
    major = F.lit(0).cast("long")
    for k in range(64):
        major = major.bitwiseOR(F.when(2 * F.col(f"b{k}") > F.col("n"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    apart = members.join(sums.select("component", major.alias("major")), "component").withColumn("apart", F.bit_count(F.col("fp").bitwiseXOR(F.col("major"))))
    nth = F.row_number().over(Window.partitionBy("component").orderBy("apart", "_text"))
    pivots = apart.select("component", "_text", nth.alias("nth")).filter(F.col("nth") <= PIVOTS).select("component", F.col("_text").alias("pivot"))
    pairs = members.select("component", "_text").join(pivots, "component").filter("pivot != _text")
    return pairs.select(F.least("pivot", "_text").alias("one"), F.greatest("pivot", "_text").alias("two"), F.col("pivot").alias("a"), F.col("_text").alias("b")).dropDuplicates(["one", "two"]).select("a", "b")


def shingle_cells(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts (``text``) fall into each of ``CELLS`` cells; that many sums reach the driver."""
    ranges = 64
    width = CELLS // ranges

    def run(batches):
        found = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(found, (shingle_set(t or b"", shingle) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        packed = [zlib.compress(found[k * width : (k + 1) * width].tobytes(), 1) for k in range(ranges)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), pa.array(packed, pa.binary())], names=["part", "cells"])

    def total(pdf):
        both = sum(np.frombuffer(zlib.decompress(x), dtype=np.uint32).astype(np.uint64) for x in pdf["cells"])
        return pdf[["part"]].head(1).assign(cells=zlib.compress(both.tobytes(), 1))

    parts = written(texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "part int, cells binary"), "cells", texts=True)
    out = np.zeros(CELLS, dtype=np.uint64)
    for r in parts.groupBy("part").applyInPandas(total, "part int, cells binary").collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(r["cells"]), dtype=np.uint64)
    discard(parts)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def prefix(hashes: np.ndarray, least: float, cells: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, those of full cells last: two sets of Jaccard ``least`` share one of them."""
    n = len(hashes)
    order = np.lexsort((hashes, cells[(hashes & np.uint64(len(cells) - 1)).astype(np.int64)]))
    return hashes[order][: n - ceil(least * n - 1e-9) + 1]


def _whole_keys(batches):
    """Batches sorted by their first column as lists of arrays, cut so that no key is in two of them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None:
        yield held


def shared_prefixes(texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """``key, n, place, _text``: the prefix shingles that several texts have, the size of the set and the place in it."""
    cells = texts.sparkSession.sparkContext.broadcast(shingle_cells(texts, shingle))  # 4 MB whatever the corpus

    def spread(batches):
        for batch in batches:
            sets = [shingle_set(t or b"", shingle) for t in batch.column(1).to_pylist()]
            firsts = [prefix(s, least, cells.value) if len(s) else s for s in sets]
            many = np.array([len(f) for f in firsts], dtype=np.int64)
            places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            cols = [np.concatenate([np.empty(0, np.uint64), *firsts]).view(np.int64), np.repeat([len(s) for s in sets], many).astype(np.int32), places.astype(np.int32), np.repeat(batch.column(0).to_numpy(), many)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "n", "place", "_text"])

    def several(batches):
        for cols in _whole_keys(batches):
            same = cols[0][1:] == cols[0][:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["key", "n", "place", "_text"])

    schema = "key long, n int, place int, _text long"
    rows = texts.select("_text", F.col("text").cast("binary").alias("text")).mapInArrow(spread, schema)
    out = written(_dealt(rows, "key").mapInArrow(several, schema), "shared", texts=True)
    cells.destroy()
    return out


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(tasks, keys[0]).sortWithinPartitions(*keys)


def prefix_pairs(shared: DataFrame, groups: DataFrame, least: float, every: bool) -> DataFrame:
    """Pairs ``a, b`` of texts of different groups that share a prefix shingle and may reach ``least``.

    ``every`` gives all of them, else only neighbours under a shingle by size.
    The texts of a shingle that very many have are dealt in blocks, and every
    two blocks of it meet somewhere.
    """
    rows = shared.join(groups, "_text", "left").withColumn("root", F.coalesce("root", "_text"))
    counts = shared.groupBy("key").count().filter(F.col("count") > GROUP_TEXTS)
    hot = written(counts.select("key", F.ceil(F.col("count") / GROUP_TEXTS).cast("int").alias("blocks")), "hot-shingles")
    one, two = F.lit(0).alias("one"), F.lit(0).alias("two")
    if every and not hot.isEmpty():
        rows = rows.join(hot, "key", "left")
        block = F.pmod(F.xxhash64("_text", F.lit(9)), F.coalesce("blocks", F.lit(1))).cast("int")
        rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        one, two = F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
        rows = rows.select("key", one, two, "block", "n", "_text", "place", "root")
    else:
        rows = rows.select("key", one, two, F.lit(0).alias("block"), "n", "_text", "place", "root")

    def run(batches):
        for code, key, one, two, block, n, text, place, root in _whole_keys(_coded(batches)):
            at, d = np.arange(len(code)), 1
            while True:
                at = at[at + d < len(code)]
                at = at[(code[at] == code[at + d]) & (n[at] >= least * n[at + d] - 1e-9)]  # sizes rise under a key
                if not len(at):
                    break
                to = at + d
                # of the first shingle that two sets share on, no more than the rest of each can be shared
                most = np.minimum(n[at] - place[at], n[to] - place[to])
                may = (root[at] != root[to]) & (most * (1 + least) >= least * (n[at].astype(np.int64) + n[to]) - 1e-6)
                may &= (one[at] == two[at]) | (block[at] != block[to])  # pairs within a block meet where it is alone
                a, b = text[at[may]], text[to[may]]
                for k in range(0, len(a), _CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[k : k + _CHUNK]), pa.array(np.maximum(a, b)[k : k + _CHUNK])], names=["a", "b"])
                if not every:
                    break
                d += 1

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(tasks, "key", "one", "two").sortWithinPartitions("key", "one", "two", "n", "_text")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _coded(batches):
    """Batches sorted by ``key, one, two`` with a running number of these three put first."""
    last, code = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns[:3]]
        change = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        first = tuple(c[0] for c in cols)
        code += last is not None and first != last
        codes = code + np.concatenate([[0], np.cumsum(change)])
        last, code = tuple(c[-1] for c in cols), int(codes[-1])
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), *batch.columns], names=["code", *batch.schema.names])


def verified_pairs(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The ``pairs`` (``a, b``) whose shingle sets are similar; ``texts`` is ``_text, text``.

    Each task makes the set of a text ``a`` once for all its ``b``; where those
    are very many, they are dealt over tasks that get ``a`` each.
    """
    counts = pairs.groupBy("a").count().filter(F.col("count") > GROUP_TEXTS).select(F.col("a").alias("h"), F.ceil(F.col("count") / GROUP_TEXTS).alias("parts"))
    dealt = pairs.join(counts, F.col("a") == F.col("h"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    first = dealt.select("a", "part", F.col("a").alias("_text"), F.lit(0).alias("side")).distinct()
    ids = written(first.unionByName(dealt.select("a", "part", F.col("b").alias("_text"), F.lit(1).alias("side"))), "pair-texts")
    needed, _ = membership(ids.select("_text"))
    rows = ids.join(needed(texts, F.col("_text")).hint("merge"), "_text")

    def run(batches):
        one, hashes = None, None
        for batch in batches:
            found = []
            for a, part, side, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = shingle_set(text or b"", shingle)
                if side == 0:
                    one, hashes = (a, part), mine
                elif one == (a, part) and similar(hashes, mine, least):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.select("a", "part", "side", "_text", F.col("text").cast("binary").alias("text"))
    return rows.repartition(tasks, "a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, radius: int = 10, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the least ``doc_id``.

    Groups are made by links of Jaccard ``similarity`` on ``shingle`` words, and
    no such link is lost. Fingerprints linked within ``radius`` bits give most
    of them at little cost: the texts of a component are compared with those
    nearest to its majority of bits. Then texts of different groups that share a
    shingle of their prefixes are compared, first with their neighbours and
    then, by the groups found so far, all of them. Rows are told apart by two
    64-bit hashes, and so are texts; only between near copies does one hash
    stand for a text.

    Nulls and odd rows: null and empty texts, and texts without words, are one
    group of their own kind each (all have no shingles); of rows with equal
    least ids a fixed one stays, and of rows repeated in full one; a row with a
    null id goes before any other; very long texts are compared whole.
    """
    names = dict(zip(("_text", "_text2", "_row", "_row2", "_nth"), unused(docs, "_text", "_text2", "_row", "_row2", "_nth"), strict=True))
    whole = F.coalesce("text", F.lit(""))
    hashes = {"_text": F.xxhash64(whole), "_text2": F.xxhash64(F.lit(1), whole), "_row": F.xxhash64("doc_id", whole), "_row2": F.xxhash64(F.lit(1), whole, "doc_id")}
    keyed = docs.withColumns({names[k]: v for k, v in hashes.items()})
    out = ["doc_id", *hashes, "fp"]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in batch.column(5).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(fps)], names=out)

    bare = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(names[k]).alias(k) for k in hashes), F.col("text").cast("binary").alias("text"))
    prints = written(bare.mapInArrow(run, "doc_id long, _text long, _text2 long, _row long, _row2 long, fp long"), "fingerprints", texts=True)
    texts = prints.groupBy("_text", "_text2").agg(F.first("fp").alias("fp"), F.min(F.struct("doc_id", "_row", "_row2")).alias("first"), F.count("*").alias("rows"))
    texts = written(texts, "texts")
    edges = written(links(texts.select("fp").distinct(), radius), "links")
    roots = connected(edges).withColumnsRenamed({"node": "fp", "root": "component"})
    grouped = texts.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    several = grouped.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    members = written(grouped.join(several, "component").select("component", "_text", "fp"), "members")
    # the first row of each text: most texts have one row, and only the others need a join
    firsts = texts.filter("rows > 1").select("_text", F.col("first._row").alias("_row"), F.col("first._row2").alias("_row2"))
    repeated, single = membership(firsts.select("_text"))
    alone = single(bare, F.col("_text")).select("_text", "text")
    exact = texts.select(F.col("first._row").alias("_row"), F.col("first._row2").alias("_row2"))
    chosen = repeated(bare, F.col("_text")).join(exact.hint("merge"), ["_row", "_row2"], "left_semi").dropDuplicates(["_row", "_row2"])
    plain = alone.unionByName(chosen.select("_text", "text"))
    shared = shared_prefixes(plain, similarity, shingle)
    none = connected(edges.limit(0)).withColumnsRenamed({"node": "_text"})
    pairs = written(pivot_pairs(members).unionByName(prefix_pairs(shared, none, similarity, False)).select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two"), "a", "b").dropDuplicates(["one", "two"]).select("a", "b"), "pairs")
    more = written(verified_pairs(pairs, plain, similarity, shingle), "verified", texts=True)
    discard(pairs, members)
    groups = connected(more).withColumnsRenamed({"node": "_text"})
    pairs = written(prefix_pairs(shared, groups, similarity, True), "pairs")
    rest = written(verified_pairs(pairs, plain, similarity, shingle), "verified", texts=True)
    discard(pairs, shared)
    final = connected(written(more.unionByName(rest), "verified")).withColumnsRenamed({"node": "_text"})
    # a text that nothing is like is a group by both its hashes
    group = [F.coalesce("root", "_text").alias("group"), F.when(F.col("root").isNull(), F.col("_text2")).alias("group2")]
    kept = texts.join(final, "_text", "left").groupBy(*group).agg(F.min("first").alias("first"))
    kept = written(kept.select(F.col("first._row").alias(names["_row"]), F.col("first._row2").alias(names["_row2"])), "kept")
    # only rows that may go, or are repeated in full, are joined; all others stay
    same = ["_row", "_row2"]
    going = prints.join(kept.withColumnsRenamed({names[k]: k for k in same}), same, "left_anti").select("_row").unionByName(prints.groupBy(*same).count().filter("count > 1").select("_row"))
    may_go, stay = membership(going)
    discard(edges, prints, texts, more, rest)
    one = F.row_number().over(Window.partitionBy(names["_row"], names["_row2"]).orderBy(names["_text"]))  # rows repeated in full
    checked = may_go(keyed, F.col(names["_row"])).join(kept.hint("merge"), [names["_row"], names["_row2"]], "left_semi").withColumn(names["_nth"], one).filter(F.col(names["_nth"]) == 1)
    return stay(keyed, F.col(names["_row"])).select(*docs.columns).unionByName(checked.select(*docs.columns))

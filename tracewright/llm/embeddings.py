"""Near-duplicate vectors by a forest of random-projection trees.

1. Equal vectors are one node (known by two hashes) with a number of copies.
2. Hot groups: on a bounded sample, centres are found about which many sampled
   vectors lie within half the angle of the threshold. Every vector within that
   half angle of a centre joins the nearest one. Any two of a group are linked,
   so their links are counted and never made. Vectors that may link with a group
   they are not in (within one and a half angles of its centre) are compared
   with all its members, in blocks.
3. All others go down the trees. A tree splits its rows at the middle of their
   projection on a random direction, again and again; rows near the middle go
   both ways (spill). Thresholds are fitted on a bounded sample; leaves that are
   still large get further rounds of splits, fitted within the leaf by the
   executors. Trees are added until partners made at exactly the threshold
   share a leaf with their sampled vectors in all but ``MISS`` of the cases.
4. In a leaf all vectors are compared in double precision. A pair counts in the
   first leaf that it shares only, which each row's list of leaves tells, so
   nothing is emitted for a pair: a leaf gives each row's number of links and a
   spanning forest. A leaf that stays large is compared in pairs of blocks.
5. Components come from the spanning forests (:mod:`.components`).

What reaches the driver is bounded: ``SAMPLE_NUMBERS`` numbers of sampled
vectors, the centres (at most ``SAMPLE_ROWS / HOT``) and their sizes. A link
that is reported holds exactly; of links between vectors outside hot groups a
few in a hundred near the threshold may be missed.

Nulls and odd rows: a vector that is null, empty, zero, or holds nulls or
numbers that aren't finite links with nothing; neither do vectors of unlike
lengths; a component id is the least id that isn't null, and null if there is
none, and a null id is kept if its component has no other id; equal vectors are linked, whatever
their ids; rows repeated in full are vectors of their own, kept or not alike;
extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import discard, written

#: Numbers of the sample that thresholds are fitted on, and vectors of it that hot groups are looked for in.
SAMPLE_NUMBERS = 1 << 22
SAMPLE_ROWS = 4096
#: Sampled vectors that make a group hot.
HOT = 16
#: Rows of a leaf that splits aim at, and sampled rows that a leaf is fitted on at least.
LEAF_ROWS, LEAF_SAMPLE = 1024, 32
#: Share of a node's rows, on either side of its middle, that go both ways.
SPILL = 0.05
#: Share of pairs at exactly the threshold that may be missed, as measured on the sample, and the most trees for it.
MISS, MOST_TREES = 0.01, 48
#: Levels of each further round of splits.
DEEPER = 5
#: Rows that one task compares with each other at most, and trees whose rows are shuffled at a time.
BLOCK_ROWS, TREES_AT_ONCE = 8192, 4


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to ``width``, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    if len(flat):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    # scaled by the largest first, so that squares neither overflow nor vanish
    out /= np.maximum(np.abs(out).max(axis=1, initial=0), np.finfo(float).tiny)[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1), np.finfo(float).tiny)[:, None], sizes


def centres(unit: np.ndarray, sizes: np.ndarray, cosine: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres with at least ``least`` of the sampled vectors within half the angle, and their vectors' lengths; densest first."""
    n, half = len(unit), np.cos(np.arccos(cosine) / 2)
    near = np.zeros((n, n), dtype=bool)
    for a in range(0, n, 512):
        near[a : a + 512] = (unit[a : a + 512] @ unit.T >= cosine) & (sizes[a : a + 512, None] == sizes[None])
    count, left, found, lengths = near.sum(axis=1), np.ones(n, dtype=bool), [], []
    while n and count.max() >= least:
        k = int(count.argmax())
        core = near[k] & left
        for _ in range(3):  # the mean of a group lies nearer to its members than they to each other
            centre = unit[core].sum(axis=0)
            centre /= max(np.linalg.norm(centre), 1e-300)
            core = (unit @ centre >= half) & left & (sizes == sizes[k])
            if core.sum() < least:
                break
        if core.sum() >= least:
            found.append(centre)
            lengths.append(sizes[k])
            left &= ~core
            count = count - near[:, core].sum(axis=1)
            count[core] = 0
        count[k] = 0
    return np.array(found).reshape(-1, unit.shape[1]), np.array(lengths, dtype=np.int64)


def directions(seed: tuple[int, ...], depth: int, width: int) -> np.ndarray:
    """A random direction for each inner node of a tree of so many levels."""
    return np.random.default_rng(seed).standard_normal(((1 << depth) - 1, width))


def fitted(unit: np.ndarray, ways: np.ndarray, depth: int, spill: float = SPILL) -> tuple[np.ndarray, np.ndarray]:
    """For each inner node what its rows are split by: up to ``high`` they go left, from ``low`` they go right."""
    low, high = np.zeros(len(ways)), np.zeros(len(ways))
    rows, node = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
    for level in range(depth):
        at = _projected(unit, rows, ways, node)
        order = np.lexsort((at, node))
        rows, node, at = rows[order], node[order], at[order]
        names, first, size = np.unique(node, return_index=True, return_counts=True)
        last = size - 1
        low[names] = at[first + np.floor(last * (0.5 - spill)).astype(np.int64)]
        high[names] = at[first + np.ceil(last * (0.5 + spill)).astype(np.int64)]
        rows, node = _children(rows, node, at, low[node], high[node])
    return low, high


def _projected(unit: np.ndarray, rows: np.ndarray, ways: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for a in range(0, len(rows), 1 << 14):
        out[a : a + (1 << 14)] = np.einsum("ij,ij->i", unit[rows[a : a + (1 << 14)]], ways[node[a : a + (1 << 14)]])
    return out


def _children(rows, node, at, low, high):
    left, right = at <= high, at >= low
    return np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])


def routed(unit: np.ndarray, ways: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves they go to (from 0); ``low`` and ``high`` by node, or by row and node."""
    rows, node = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
    for _ in range(depth):
        at = _projected(unit, rows, ways, node)
        a, b = (low[node], high[node]) if low.ndim == 1 else (low[rows, node], high[rows, node])
        rows, node = _children(rows, node, at, a, b)
    return rows, node - ((1 << depth) - 1)


def _shared(a: tuple, b: tuple, leaves: int) -> np.ndarray:
    """Which rows have a leaf in common in two routings of as many rows."""
    out = np.zeros(int(max(a[0].max(initial=-1), b[0].max(initial=-1))) + 1, dtype=bool)
    both = np.intersect1d(a[0] * leaves + a[1], b[0] * leaves + b[1])
    out[both // leaves] = True
    return out


def forest(unit: np.ndarray, sizes: np.ndarray, rows: int, cosine: float, seed: int = 11) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Trees ``depth, low, high`` for so many rows, enough that partners at exactly the threshold are found."""
    n, width = unit.shape
    depth = int(max(0, min(np.ceil(np.log2(max(rows, 1) / LEAF_ROWS)), np.floor(np.log2(max(n, 1) / LEAF_SAMPLE)))))
    if depth == 0:
        return [(0, np.zeros(0), np.zeros(0))]
    rng = np.random.default_rng(seed)
    some = unit[: 1 << 12]
    aside = rng.standard_normal(some.shape) * (np.arange(width)[None] < sizes[: 1 << 12, None])
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    partners = cosine * some + np.sqrt(1 - cosine**2) * aside
    trees, missed = [], np.ones(len(some), dtype=bool)
    while len(trees) < MOST_TREES and missed.mean() > MISS:
        ways = directions((seed, len(trees)), depth, width)
        low, high = fitted(unit, ways, depth)
        trees.append((depth, low, high))
        missed &= ~_shared(routed(some, ways, depth, low, high), routed(partners, ways, depth, low, high), 1 << depth)[: len(some)]
    return trees


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets (each under its least row) that pairs of rows connect."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


FOUND = "edge boolean, a long, b long"
_FOUND = pa.schema([("edge", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def _report(nodes: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    some = counts > 0
    edge = np.concatenate([np.zeros(some.sum(), dtype=bool), np.ones(len(a), dtype=bool)])
    return pa.table([pa.array(edge), pa.array(np.concatenate([nodes[some], a]).astype(np.int64)), pa.array(np.concatenate([counts[some], b]).astype(np.int64))], schema=_FOUND)


def _compared(table: pa.Table, width: int, cosine: float) -> pa.Table:
    """Links of each row of a leaf, and a spanning forest, over the pairs that share no leaf before this one."""
    unit, sizes = _matrix(table["vector"], width)
    nodes, copies, block = (table[c].to_numpy() for c in ("node", "copies", "block"))
    n, two = len(nodes), table["low"][0].as_py() != table["high"][0].as_py()
    before = table["before"].combine_chunks()
    long = np.diff(before.offsets.to_numpy()).astype(np.int64)
    seen = np.full((n, int(long.max(initial=0))), -1, dtype=np.int64)
    seen[np.repeat(np.arange(n), long), np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)] = before.flatten().to_numpy()
    counts, label = np.zeros(n, dtype=np.int64), np.arange(n)
    for start in range(0, n, 512):
        one = slice(start, min(start + 512, n))
        met = unit[one] @ unit[start:].T >= cosine
        met &= (np.arange(start, n)[None] > np.arange(one.start, one.stop)[:, None]) & (sizes[one, None] == sizes[None, start:])
        if two:
            met &= block[one, None] != block[None, start:]
        a, b = np.nonzero(met)
        a, b = a + start, b + start
        for at in range(0, len(a), 1 << 14):
            i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            new = np.ones(len(i), dtype=bool)
            for k in range(seen.shape[1]):
                new &= ~((seen[i, k, None] == seen[j]) & (seen[i, k, None] >= 0)).any(axis=1)
            i, j = i[new], j[new]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            _united(label, i, j)
    child = np.flatnonzero(label != np.arange(n))
    return _report(nodes, counts, nodes[child], nodes[label[child]])


def _against(members: pa.Table, others: pa.Table, width: int, cosine: float) -> pa.Table:
    """Links between members of a hot group and vectors outside it; members count those outside any group only, since vectors of other groups count for themselves."""
    if not members.num_rows or not others.num_rows:
        return _FOUND.empty_table()
    unit, sizes = _matrix(members["place"], width)
    theirs, lengths = _matrix(others["vector"], width)
    own, copies = members["times"].to_numpy(), others["copies"].to_numpy()
    nodes, group = others["node"].to_numpy(), others["hot"].to_numpy()
    counted, linked = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
    for start in range(0, len(nodes), 512):
        part = slice(start, start + 512)
        met = (theirs[part] @ unit.T >= cosine) & (lengths[part, None] == sizes[None])
        counted[part] = met @ own
        linked += (copies[part] * (group[part] < 0)) @ met
    some = counted > 0
    home = np.where(group < 0, nodes, -group - 1)[some]
    edges = np.unique(home)
    out = _report(nodes, counted, edges, np.full(len(edges), -members["of"][0].as_py() - 1))
    return pa.concat_tables([out, _report(members["member"].to_numpy(), linked, np.zeros(0), np.zeros(0))])


def _assigned(nodes: DataFrame, middle: np.ndarray, lengths: np.ndarray, width: int, cosine: float) -> DataFrame:
    """``nodes`` with ``hot`` (the nearest centre within half the angle, or -1) and ``near`` (other groups that it may link with)."""
    angle = float(np.arccos(cosine))

    def run(batches):
        for batch in batches:
            unit, sizes = _matrix(batch.column(batch.schema.get_field_index("vector")), width)
            apart = np.arccos(np.clip(unit @ middle.T, -1, 1))
            apart[sizes[:, None] != lengths[None]] = np.inf
            own = np.where(apart.min(axis=1) <= angle / 2 - 1e-9, apart.argmin(axis=1), -1)
            may = apart <= 1.5 * angle + 1e-9
            may[own >= 0, own[own >= 0]] = False
            near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(may.sum(axis=1))]), pa.int32()), pa.array(np.nonzero(may)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), near], names=[*batch.schema.names, "hot", "near"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, f"{kinds}, hot int, near array<int>")


def _cross(assigned: DataFrame, groups: list, width: int, cosine: float) -> DataFrame:
    """What :func:`_against` finds for all hot groups: members in blocks, others in chunks, each pair of them a task's."""
    spark = assigned.sparkSession
    others = assigned.select("node", "copies", "vector", "hot", F.explode("near").alias("of"))
    asked = {r["of"]: r["n"] for r in others.groupBy("of").agg(F.count("*").alias("n")).collect()}  # a row for each centre
    deals = [(g["hot"], -(-g["n"] // BLOCK_ROWS), -(-asked[g["hot"]] // BLOCK_ROWS)) for g in groups if g["hot"] in asked]
    if not deals:
        return spark.createDataFrame([], FOUND)
    table = F.broadcast(spark.createDataFrame(deals, "of int, blocks int, chunks int"))  # at most a row for each centre

    def dealt(rows: DataFrame, own: str, every: str, key: str) -> DataFrame:
        spot = F.shiftrightunsigned(F.xxhash64(F.lit(5), key), 1)
        ours, theirs = ("block", "chunk") if own == "blocks" else ("chunk", "block")
        return rows.join(table, "of").withColumn(ours, (spot % F.col(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(every) - 1))).drop("blocks", "chunks")

    inside = assigned.filter("hot >= 0").select(F.col("node").alias("member"), F.col("copies").alias("times"), F.col("vector").alias("place"), F.col("hot").alias("of"))
    members = dealt(inside, "blocks", "chunks", "member")
    asking = dealt(others, "chunks", "blocks", "node")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _against(left, right, width, cosine)

    return members.groupBy("of", "block", "chunk").cogroup(asking.groupBy("of", "block", "chunk")).applyInArrow(run, FOUND)


def _deeper(singles: DataFrame, placed: DataFrame, width: int, seed: int, level: int) -> DataFrame | None:
    """``placed`` (``node, leaf``) with its large leaves split further, or None if there are none."""
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * LEAF_ROWS)
    sizes = written(sizes, "leaf-sizes")
    if sizes.isEmpty():
        return None
    ways = directions((seed, 1 << 20, level), DEEPER, width)
    rows = placed.join(sizes, "leaf").join(singles.select("node", "vector"), "node")
    wanted = F.lit(float(LEAF_SAMPLE << DEEPER)) / F.col("n") * float(1 << 31)

    def fit(table: pa.Table) -> pa.Table:
        low, high = fitted(_matrix(table["vector"], width)[0], ways, DEEPER)
        return pa.table({"leaf": table["leaf"][:1], "lows": pa.array([low.tolist()], pa.list_(pa.float64())), "highs": pa.array([high.tolist()], pa.list_(pa.float64()))})

    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(9), "node", "leaf"), F.lit(1 << 31)) < wanted).select("leaf", "vector")
    model = written(drawn.groupBy("leaf").applyInArrow(fit, "leaf long, lows array<double>, highs array<double>"), "splits")

    def run(batches):
        for batch in batches:
            unit, _ = _matrix(batch.column(1), width)
            low, high = (np.array(batch.column(k).flatten()).reshape(len(unit), -1) for k in (3, 4))
            at, leaf = routed(unit, ways, DEEPER, low, high)
            node, old = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array((old[at] << (DEEPER + 1)) + leaf + 1)], names=["node", "leaf"])

    split = rows.join(model, "leaf").select("node", "vector", "leaf", "lows", "highs").mapInArrow(run, "node long, leaf long")
    rest = placed.join(model.select("leaf"), "leaf", "left_anti").select("node", F.shiftleft("leaf", DEEPER + 1).alias("leaf"))
    return written(split.unionByName(rest), "leaves")


def _linked(singles: DataFrame, trees: list, width: int, cosine: float, seed: int = 11, rounds: int = 6) -> list[DataFrame]:
    """What :func:`_compared` finds in all leaves of all trees, as written tables."""
    depth = trees[0][0]

    def run(batches):
        ways = [directions((seed, t), depth, width) for t in range(len(trees))]
        for batch in batches:
            unit, _ = _matrix(batch.column(1), width)
            node = batch.column(0).to_numpy()
            for t, (_, low, high) in enumerate(trees):
                at, leaf = routed(unit, ways[t], depth, low, high)
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array((t << depth) + leaf)], names=["node", "leaf"])

    placed, shift = written(singles.select("node", "vector").mapInArrow(run, "node long, leaf long"), "leaves"), depth
    for level in range(rounds):
        more = _deeper(singles, placed, width, seed, level)
        if more is None:
            break
        discard(placed)
        placed, shift = more, shift + DEEPER + 1
    blocks = placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_ROWS).select("leaf", F.ceil(F.col("n") / (BLOCK_ROWS // 2)).cast("int").alias("blocks"))
    blocks = written(blocks, "leaf-blocks")  # as a rule none
    lists = written(placed.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")), "leaf-lists")
    discard(placed)
    found = []
    for t in range(0, len(trees), TREES_AT_ONCE):
        inside = F.filter("leaves", lambda x: (x >= F.lit(t << shift)) & (x < F.lit((t + TREES_AT_ONCE) << shift)))
        rows = singles.select("node", "copies", "vector").join(lists.select("node", "leaves", F.explode(inside).alias("leaf")), "node")
        rows = rows.withColumn("before", F.filter("leaves", lambda x: x < F.col("leaf"))).drop("leaves").join(blocks, "leaf", "left")
        many = F.coalesce("blocks", F.lit(1))
        rows = rows.withColumn("block", (F.shiftrightunsigned(F.xxhash64(F.lit(5), "node"), 1) % many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
        rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
        found.append(written(rows.groupBy("leaf", "low", "high").applyInArrow(lambda table: _compared(table, width, cosine), FOUND), "links"))
    return found


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """``key``, ``n_links`` (other vectors at cosine ``cosine`` or more), ``component_id`` (least key that links reach) and ``kept`` of every row."""
    v = F.col(vector)
    usable = vectors.select(F.col(key).cast("long").alias("id"), v.alias("vector"), _usable(v).alias("usable"), F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2"))
    reps = usable.filter("usable").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total = reps.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("width")).first()
    width = total["width"]
    most = max(1, SAMPLE_NUMBERS // width)
    bound = int(min(1.0, most / max(total["n"], 1)) * (1 << 31))
    drawn = reps.filter(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 31)) < bound).select("vector").limit(most).toArrow()
    sample, sizes = _matrix(drawn["vector"], width) if drawn.num_rows else (np.zeros((0, width)), np.zeros(0, dtype=np.int64))
    middle, lengths = centres(sample[:SAMPLE_ROWS], sizes[:SAMPLE_ROWS], cosine, HOT)
    if len(middle):
        assigned = written(_assigned(reps, middle, lengths, width, cosine), "assigned")
    else:
        assigned = reps.withColumns({"hot": F.lit(-1), "near": F.array().cast("array<int>")})
    hot = assigned.filter("hot >= 0").groupBy("hot").agg(F.sum("copies").alias("weight"), F.count("*").alias("n"), F.min("least").alias("least"))
    groups = hot.collect() if len(middle) else []  # a row for each centre
    singles = assigned.filter("hot < 0").select("node", "copies", "vector")
    parts = []
    if groups:
        parts.append(written(_cross(assigned, groups, width, cosine), "links"))
        apart = np.arccos(np.clip(sample @ middle.T, -1, 1))
        apart[sizes[:, None] != lengths[None]] = np.inf
        alone = apart.min(axis=1) > np.arccos(cosine) / 2
        sample, sizes = sample[alone], sizes[alone]
    if total["n"]:
        parts += _linked(singles, forest(sample, sizes, singles.count(), cosine), width, cosine)
    found = parts[0] if parts else vectors.sparkSession.createDataFrame([], FOUND)
    for part in parts[1:]:
        found = found.unionByName(part)
    counts = found.filter("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    roots = connected(written(found.filter("edge").select("a", "b").distinct(), "edges"))
    weights = vectors.sparkSession.createDataFrame([(g["hot"], g["weight"]) for g in groups], "hot int, weight long")
    home = F.when(F.col("hot") >= 0, -F.col("hot").cast("long") - 1).otherwise(F.col("node"))
    homes = assigned.select("node", "h1", "h2", "copies", "least", "hot", home.alias("home")).join(roots.select(F.col("node").alias("home"), "root"), "home", "left")
    homes = homes.withColumn("root", F.coalesce("root", "home"))
    least = homes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = homes.join(least, "root").join(counts, "node", "left").join(F.broadcast(weights), "hot", "left")
    links = F.coalesce("n", F.lit(0)) + F.coalesce("weight", "copies") - 1
    nodes = nodes.select("h1", "h2", links.alias("n_links"), "component_id")
    keys = usable.select("id", F.when(F.col("usable"), F.col("h1")).alias("h1"), F.when(F.col("usable"), F.col("h2")).alias("h2"))
    out = keys.join(nodes, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

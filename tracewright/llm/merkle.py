"""Merkle manifest of a table: a tree for each group of rows, and one tree over the groups' roots.

A leaf is the SHA-256 of a row's columns. Leaves are numbered densely in their
group, and every 16³ consecutive ones are a bucket. A DuckDB engine in
the executors takes aligned Arrow buckets (whole ones, a few at a time) through
three levels by ordered ``string_agg`` and ``sha256``. Spark then combines the
buckets' roots: they are the leaves of the next three levels, until a group has
one node. The groups' roots, ordered, make the last tree in the same way. The
siblings on the way from a bucket up to the root are its outer proof, joined
round by round; it meets the rows of its bucket in the last step, where
DuckDB adds the siblings within the bucket and folds every claimed leaf up to
the root.

A bucket is at most 4096 leaves of 64 characters, whatever the group, so a group
with a third of all rows is as many tasks as it needs. Texts are read once and
never shuffled: only their hashes are. Levels above are 1/4096 of the ones
below, and nothing of them reaches the driver but the size of the largest group.

Nulls and odd rows: a null column is ``-`` in the leaf, and a null group comes
first as a group of its own; a null key comes first in its group; rows with the
same group and key are in order of their leaves, and rows repeated in full are
a leaf each; very long texts are hashed whole; columns that aren't named are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .shared import discard, written



@dataclass(frozen=True)
class Shape:
    """Children of a node, levels that the engine takes at once, and so leaves of a bucket."""

    fan: int = 16
    levels: int = 3

    @property
    def bucket(self) -> int:
        return self.fan**self.levels


#: Rows that the engine takes at least, unless there are no more.
BLOCK_ROWS = 8192
#: Rows of the Arrow batches that bring out proofs.
OUT_ROWS = 1024


def leaf(*columns: Column) -> Column:
    """SHA-256 (lower-case hex) over each column's text as ``<bytes>:<text>``, or ``-`` where it is null."""

    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, columns)), 256)


def _levels(nodes: Column, shape: Shape) -> Column:
    """Levels from so many nodes to one, as far as a bucket goes."""
    found, k = F.lit(shape.levels), shape.levels - 1
    while k >= 0:
        found, k = F.when(nodes <= shape.fan**k, k).otherwise(found), k - 1
    return found


def aligned(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """Consecutive rows as tables of at least ``rows`` that part no bucket (``tree, bucket``), numbered from 0 as ``b``."""

    def numbered_buckets(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tree, bucket = table["tree"].combine_chunks(), table["bucket"].combine_chunks()
        n = len(tree)
        new = pc.or_(pc.not_equal(tree.slice(1), tree.slice(0, n - 1)), pc.not_equal(bucket.slice(1), bucket.slice(0, n - 1)))
        number = pc.cumulative_sum(pa.concat_arrays([pa.array([0], pa.int64()), new.cast(pa.int64())]))
        return table.append_column("b", number)

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = numbered_buckets(pa.Table.from_batches(held))
            last = pc.equal(table["b"], table["b"][n - 1])
            cut = n - pc.sum(last).as_py()
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).drop_columns(["b"]).to_batches()
            n -= cut
    if held:
        yield numbered_buckets(pa.Table.from_batches(held))


def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})


def _make(con, sql: str) -> None:
    con.execute(sql).fetchall()


def _climb(con, source: str, shape: Shape) -> None:
    """Tables ``c1..`` (runs of siblings by bucket) and ``n0..`` (nodes by bucket) over ``source`` (``b, place, levels, hash``)."""
    _make(con, f"CREATE OR REPLACE TEMP TABLE n0 AS SELECT b, place, levels, hash FROM {source}")
    for k in range(1, shape.levels + 1):
        _make(con, f"CREATE OR REPLACE TEMP TABLE c{k} AS SELECT b, place // {shape.fan} AS run, levels, string_agg(hash, '' ORDER BY place) AS hashes FROM n{k - 1} WHERE levels >= {k} GROUP BY ALL")
        _make(con, f"CREATE OR REPLACE TEMP TABLE n{k} AS SELECT b, run AS place, levels, sha256(hashes) AS hash FROM c{k}")


def _beside(rows: str, shape: Shape) -> tuple[str, list[tuple[str, str]]]:
    """The joins of ``rows`` with the runs above them, and at each level the siblings on the left and on the right (null above the bucket's root)."""
    joins, sides = "", []
    for k in range(1, shape.levels + 1):
        joins += f" LEFT JOIN c{k} ON c{k}.b = {rows}.b AND c{k}.run = {rows}.place // {shape.fan**k}"
        spot = f"(({rows}.place // {shape.fan ** (k - 1)}) % {shape.fan}) * 64"
        sides.append((f"substr(c{k}.hashes, 1, {spot})", f"substr(c{k}.hashes, {spot} + 65)"))
    return joins, sides


def _bucketed(nodes: DataFrame, shape: Shape) -> DataFrame:
    """Nodes ``tree, rank, nodes, hash`` with their bucket, place and levels there, each bucket's rows together and in order."""
    placed = nodes.select("tree", F.expr(f"rank div {shape.bucket}").alias("bucket"), (F.col("rank") % shape.bucket).cast("int").alias("place"), "nodes", _levels(F.col("nodes"), shape).alias("levels"), "hash")
    return placed.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "place")


def _roots(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The root of every bucket, as nodes of the level above: ``tree, rank, nodes, hash``."""

    def run(batches):
        with _engine() as con:
            for block in aligned(batches):
                con.register("block", block)
                _climb(con, "block", shape)
                _make(con, "CREATE OR REPLACE TEMP TABLE buckets AS SELECT DISTINCT b, tree, bucket, nodes FROM block")
                each = " UNION ALL ".join(f"SELECT b, hash FROM n{k} WHERE levels = {k}" for k in range(shape.levels + 1))
                found = con.sql(f"SELECT tree, bucket AS rank, (nodes + {shape.bucket - 1}) // {shape.bucket} AS nodes, hash FROM buckets JOIN ({each}) USING (b)").to_arrow_table()
                con.unregister("block")
                yield from found.to_batches()

    return _bucketed(nodes, shape).mapInArrow(run, "tree string, rank long, nodes long, hash string")


def _paths(nodes: DataFrame, shape: Shape) -> DataFrame:
    """Every node's siblings within its bucket, level by level: ``tree, rank, lefts, rights``."""

    def run(batches):
        with _engine() as con:
            for block in aligned(batches):
                con.register("block", block)
                _climb(con, "block", shape)
                joins, sides = _beside("block", shape)
                lefts, rights = (", ".join(x) for x in zip(*sides, strict=True))
                kept = "list_filter([{}], lambda x: x IS NOT NULL)"
                found = con.sql(f"SELECT tree, bucket * {shape.bucket} + block.place AS rank, {kept.format(lefts)} AS lefts, {kept.format(rights)} AS rights FROM block{joins}").to_arrow_table()
                con.unregister("block")
                yield from found.to_batches(OUT_ROWS)

    return _bucketed(nodes, shape).mapInArrow(run, "tree string, rank long, lefts array<string>, rights array<string>")


def _grown(leaves: DataFrame, label: str, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Roots ``tree, hash`` of all trees over written leaves ``tree, rank, nodes, hash``, and the outer proof ``tree, bucket, lefts, rights`` of every bucket of leaves."""
    layers = []
    done = written(_roots(leaves, shape), label)
    roots = done.filter("nodes = 1").select("tree", "hash")
    above = done
    while not above.filter("nodes > 1").isEmpty():  # a round for each factor of a bucket in the largest group
        layer = written(above.filter("nodes > 1"), label)
        layers.append(layer)
        above = written(_roots(layer, shape), label)
        roots = roots.unionByName(above.filter("nodes = 1").select("tree", "hash"))
    outer = None
    for layer in reversed(layers):  # from the top: siblings of the node, then those above its bucket
        path = _paths(layer, shape)
        if outer is not None:
            more = outer.select("tree", "bucket", F.col("lefts").alias("_l"), F.col("rights").alias("_r"))
            path = path.withColumn("bucket", F.expr(f"rank div {shape.bucket}")).join(more, ["tree", "bucket"], "left")
            path = path.select("tree", "rank", F.concat("lefts", F.coalesce("_l", F.array().cast("array<string>"))).alias("lefts"), F.concat("rights", F.coalesce("_r", F.array().cast("array<string>"))).alias("rights"))
        outer = written(path.select("tree", F.col("rank").alias("bucket"), "lefts", "rights"), label)
    empty = F.array().cast("array<string>")
    lone = done.filter("nodes = 1").select("tree", F.col("rank").alias("bucket"), empty.alias("lefts"), empty.alias("rights"))
    return roots, lone if outer is None else lone.unionByName(outer)


def _proved(rows: DataFrame, shape: Shape) -> DataFrame:
    """Rows of leaves (``outer`` false) and of their buckets' outer proofs (``outer`` true), folded; see :func:`manifest`."""
    key = rows.schema["key"].dataType.simpleString()

    def run(batches):
        with _engine() as con:
            for block in aligned(batches):
                con.register("block", block)
                _make(con, "CREATE OR REPLACE TEMP TABLE leaves AS SELECT b, place, levels, hash, key, part, claimed FROM block WHERE NOT \"outer\"")
                _make(con, "CREATE OR REPLACE TEMP TABLE outers AS SELECT b, lefts, rights, array_to_string(list_transform(range(1, len(lefts) + 1), lambda k: lefts[k] || rights[k]), '') AS rest, subroot, root FROM block WHERE \"outer\"")
                con.unregister("block")
                _climb(con, "leaves", shape)
                joins, sides = _beside("leaves", shape)
                near = " || ".join(f"coalesce({a} || {b}, '')" for a, b in sides)
                columns = ", ".join(f"{a} AS l{k}, {b} AS r{k}" for k, (a, b) in enumerate(sides))
                sql = f"SELECT key, part, hash AS leaf, subroot, root, {near} || rest AS proof, coalesce(claimed, hash) AS f, lefts, rights, {columns} FROM leaves JOIN outers USING (b){joins}"
                fold = "key, part, leaf, subroot, root, proof, lefts, rights"
                for k in range(shape.levels):
                    later = "".join(f", l{j}, r{j}" for j in range(k + 1, shape.levels))
                    sql = f"SELECT {fold}{later}, CASE WHEN l{k} IS NULL THEN f ELSE sha256(l{k} || f || r{k}) END AS f FROM ({sql})"
                ((most,),) = con.execute("SELECT coalesce(max(len(lefts)), 0) FROM outers").fetchall()
                for k in range(1, most + 1):
                    sql = f"SELECT {fold}, CASE WHEN len(lefts) < {k} THEN f ELSE sha256(lefts[{k}] || f || rights[{k}]) END AS f FROM ({sql})"
                found = con.sql(f"SELECT key, part, leaf, subroot, root, proof, f AS folded_root FROM ({sql})").to_arrow_reader(OUT_ROWS)
                yield from found

    return rows.mapInArrow(run, f"key {key}, part string, leaf string, subroot string, root string, proof string, folded_root string")


def manifest(rows: DataFrame, key: str, group: str, hashed: Column, claimed: Column | None = None, shape: Shape = Shape()) -> DataFrame:
    """``key, group, leaf, subroot, root, proof, folded_root, verified`` of every row.

    ``hashed`` is the leaf (:func:`leaf`). Leaves ascend by ``key`` within a
    ``group``. ``proof`` is the text of all siblings from the leaf up to the
    root, 64 characters each. ``claimed`` is a leaf to check instead of a row's
    own where it isn't null: ``folded_root`` is what it and the siblings come
    to, ``verified`` whether that is the root.
    """
    part = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("-"))  # orders as the group does, a null first
    claimed = F.lit(None).cast("string") if claimed is None else claimed
    base = rows.select(part.alias("tree"), F.col(key).alias("key"), F.col(group).cast("string").alias("part"), hashed.alias("hash"), claimed.alias("claimed"))
    leaves = written(numbered(base, [F.col("key").asc_nulls_first(), F.col("hash")], ["tree"], total="nodes"), "leaves")
    subroots, outer = _grown(leaves, "nodes", shape)
    # the tree over the groups' roots
    tops = written(numbered(subroots.select(F.lit("").alias("all"), F.col("tree").alias("of"), "hash"), [F.col("of")], ["all"], total="nodes"), "tops")
    top_leaves = tops.select(F.col("all").alias("tree"), "rank", "nodes", "hash")
    top, top_outer = _grown(top_leaves, "tops", shape)
    more = top_outer.select("tree", "bucket", F.col("lefts").alias("_l"), F.col("rights").alias("_r"))
    inner = _paths(top_leaves, shape).withColumn("bucket", F.expr(f"rank div {shape.bucket}")).join(more, ["tree", "bucket"])
    paths = inner.select("tree", "rank", F.concat("lefts", "_l").alias("_l"), F.concat("rights", "_r").alias("_r"))
    above = tops.select(F.col("all"), "rank", "of", F.col("hash").alias("subroot")).join(paths.withColumnRenamed("tree", "all"), ["all", "rank"])
    above = above.join(top.select(F.col("tree").alias("all"), F.col("hash").alias("root")), "all").select(F.col("of").alias("tree"), "subroot", "root", "_l", "_r")
    proofs = outer.join(written(above, "tops"), "tree").select("tree", "bucket", F.concat("lefts", "_l").alias("lefts"), F.concat("rights", "_r").alias("rights"), "subroot", "root")

    own = leaves.select("tree", F.expr(f"rank div {shape.bucket}").alias("bucket"), (F.col("rank") % shape.bucket).cast("int").alias("place"), _levels(F.col("nodes"), shape).alias("levels"), "hash", "key", "part", "claimed", F.lit(False).alias("outer"))
    both = own.unionByName(proofs.withColumns({"outer": F.lit(True), "place": F.lit(-1)}), allowMissingColumns=True)
    # a bucket's proof travels with its rows, so the texts of siblings are put together where they are used
    found = _proved(both.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "place"), shape)
    return found.select(F.col("key").alias(key), F.col("part").alias(group), "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

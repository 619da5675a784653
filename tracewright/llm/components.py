"""Connected components by hooking and contraction, with every step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _jumped(parent: DataFrame) -> DataFrame:
    """Follow parents until every node points at the root of its tree; doubles the reach at each step."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = written(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jump")
        moved = not new.filter("moved").isEmpty()
        discard(parent)
        parent = new.select("node", "root")
        parent._tracewright_path = new._tracewright_path
        if not moved:
            return parent


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); nodes of one component share a root.

    Each round hooks every node to its least neighbour, contracts the trees and
    goes on with the links between them. Only nodes that are their own least
    neighbour stay, at most half of those with a link, so the rounds are at most
    the logarithm of the nodes. Null ends and loops are ignored.
    """
    found, first = None, True
    while True:
        both = edges.filter("a != b").select("a", "b").union(edges.filter("a != b").select("b", "a"))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parent = _jumped(written(low.select("node", F.least("node", "least").alias("root")), "hooks"))
        if found is None:
            found = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            new = written(found.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
            discard(found, parent)
            found = new
        one, two = found.withColumnsRenamed({"node": "a", "root": "ra"}), found.withColumnsRenamed({"node": "b", "root": "rb"})
        if first:
            original = edges.filter("a != b")
        rest = original.join(one, "a").join(two, "b").filter("ra != rb")
        new_edges = written(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "contracted")
        if not first:
            discard(edges)
        edges, first = new_edges, False
        if edges.isEmpty():
            return found

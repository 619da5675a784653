"""Best-fit packing of token sequences.

Best-fit decreasing looks only at lengths, and there are at most ``capacity``
of them, so the plan is made from the histogram of piece lengths: sequences
with the same free space are held together as ranges of sequence ids, and a
segment tree over free space gives the tightest open sequence for a length in
logarithmic time. A range that takes k pieces of length L keeps less than half
of its free space at each full use, so the plan has at most
``3 * capacity * log2(capacity)`` runs whatever the size of the corpus; that
bounds what is broadcast. Pieces then find their place by their rank among the
pieces of the same length.

Nulls and odd rows: a null text is an empty text (its only token is the end
id); a null id is kept as it is; rows repeated in full are packed as often as
they occur; a very long text becomes pieces of the whole capacity and one rest;
pieces of equal length are placed in the order of a hash, then of their ids;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that are ranked together, in the mean.
RANK_ROWS = 4096


class FreeSpace:
    """Segment tree over free space 0..capacity that finds the least non-empty one of at least a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.used = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, free: int, first: int, count: int) -> None:
        """Sequences ``first .. first + count - 1`` have ``free`` tokens left."""
        self.ranges[free].append((first, count))
        at = self.leaves + free
        while at and not self.used[at]:
            self.used[at] = 1
            at >>= 1

    def take(self, free: int) -> tuple[int, int]:
        out = self.ranges[free].pop()
        at = self.leaves + free
        if not self.ranges[free]:
            self.used[at] = 0
            while at > 1 and not self.used[at ^ 1]:
                at >>= 1
                self.used[at] = 0
        return out

    def tightest(self, length: int) -> int | None:
        at = self.leaves + length
        if at >= 2 * self.leaves:
            return None
        while not self.used[at]:
            while at & 1:  # a right child: its parent has nothing further right
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.used[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, pieces, first sequence, pieces in each, offset)`` of the plan for a histogram of lengths."""
    space, opened, runs = FreeSpace(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            free = space.tightest(length)
            if free is None:
                each = capacity // length
                first, count, free = opened, -(-left // each), capacity
                opened += count
            else:
                first, count = space.take(free)
                each = free // length
            full, rest = divmod(left, each)
            whole = min(count, full)
            if whole:
                runs.append((length, rank, whole * each, first, each, capacity - free))
                rank, left = rank + whole * each, left - whole * each
                space.put(free - each * length, first, whole)
                first, count = first + whole, count - whole
            if count and left:  # fewer pieces are left than one sequence takes
                runs.append((length, rank, rest, first, each, capacity - free))
                rank, left = rank + rest, 0
                space.put(free - rest * length, first, 1)
                first, count = first + 1, count - 1
            if count:
                space.put(free, first, count)
    return runs


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``ids`` (little-endian 32-bit) on request."""
    schema = PIECES + (", ids binary" if with_ids else "")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        enc, end = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in types]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for col, value in zip(cols, row, strict=False):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, schema)


def ranked(table: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``table`` (stored pieces) with ``rank``, from 0 without gaps among the pieces of a length.

    ``counts`` is the histogram of lengths. A length that a third of all pieces
    share is dealt over many tasks by a hash; only counts for each length and
    bucket are then summed in order.
    """
    each = [max(1, -(-counts.get(length, 0) // RANK_ROWS)) for length in range(1, max(counts, default=1) + 1)]  # at most ``capacity`` lengths
    buckets = F.element_at(F.split(F.lit(",".join(map(str, each))), ",").cast("array<int>"), F.col("length").cast("int"))
    spread = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    out = spread.withColumn("within", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    return out.withColumn("rank", F.col("base") + F.col("within")).drop("bucket", "base", "within")


def placed(table: DataFrame, capacity: int) -> DataFrame:
    """Stored pieces with ``sequence_id`` and ``offset`` by best-fit decreasing."""
    spark = table.sparkSession
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(best_fit_decreasing(counts, capacity), dtype=np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    plan = spark.sparkContext.broadcast(runs)
    rows = ranked(table, counts)
    names = [*table.columns, "sequence_id", "offset"]

    def place(batches):
        lengths, firsts, _, sequences, each, offsets = plan.value.T
        keys = (lengths << 48) + firsts
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            k = rank - firsts[run]
            kept = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequences[run] + k // each[run]), pa.array(offsets[run] + k % each[run] * length)], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    return rows.select(*table.columns, "rank").mapInArrow(place, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into as few sequences of ``capacity`` ids as best-fit decreasing finds.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, on request, the piece's ``ids``.
    """
    table = written(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces", texts=True)
    return placed(table, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from pieces packed ``with_ids``: a row per sequence with its ids (bounded by the capacity)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )


def simple_best_fit(lengths: list[int], capacity: int) -> int:
    """Sequences that plain best-fit decreasing opens, one piece at a time (for tests)."""
    free: list[int] = []
    for length in sorted(lengths, reverse=True):
        at = bisect_left(free, length)
        room = free.pop(at) if at < len(free) else capacity
        at = bisect_left(free, room - length)
        free.insert(at, room - length)
    # a full sequence stays in the list with nothing free
    return len(free)

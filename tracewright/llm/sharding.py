"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt into parts by a hash. How many rows part i sends to shard s is
drawn for all parts and shards together: with shard sizes fixed, the counts of
a uniform random assignment follow multivariate hypergeometric laws, part by
part, from what the shards still lack. Each part permutes its rows and cuts
them by its line of the matrix; each shard permutes what it gets. The result is
one uniform permutation cut into shards whose sizes differ by at most one. All
permutations come from hashes with a seed, so a repeated task gives the same
rows.

Only the numbers of rows of the parts reach the driver, and the matrix (parts
times shards) goes back as a small table; ``MAX_PARTS`` bounds both. A shard of
over ``BLOCK_ROWS`` rows is permuted in blocks of its second hash, whose sizes
are counted first, so no task holds a whole shard.

The hash covers the identity columns and the row's place in its file, so rows
repeated in full are dealt like any others. Parts, shards and slots are worked
out on these hashes from several scans, which may be cut into other splits each
time, as executors come and go; a row's file and its place in it stay the same.
A table that doesn't come straight from Parquet files is written once, and what
was written is read.

Nulls and odd rows: the hash covers nulls; rows that are repeated in full, and
ties of a hash, are in arbitrary but fixed order; a very long text is carried
as it is; extra columns are carried along, but an input column ``shard`` or
``slot`` gives way to the result's; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal, localcontext
from functools import lru_cache

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import unused, written

MAX_PARTS = 20_000
#: Rows that one part permutes, in the mean (up to ``MAX_PARTS``).
PART_ROWS = 1 << 18
BLOCK_ROWS = 4096


@lru_cache(maxsize=1 << 16)
def log_factorial(n: int) -> Decimal:
    """Natural logarithm of n! to about 30 digits, by Stirling's series above 1000."""
    with localcontext() as context:
        context.prec = 40
        if n < 1000:
            return Decimal(math.factorial(n)).ln()
        x = Decimal(n)
        series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
        return (x + Decimal("0.5")) * x.ln() - x + Decimal("1.837877066409345483560659472811235279722794947275566825634") / 2 + series


def log_choose(n: int, k: int) -> Decimal:
    with localcontext() as context:
        context.prec = 40
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw of how many of ``draws`` without replacement are ``good``: by numpy, or by inversion from the mode where that stops.

    The mode's probability is worked out in 40 digits, since the logarithms of
    such factorials leave nothing of a double's.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    down, up, p_down, p_up = mode, mode, at_mode, at_mode
    while left > 0 and (down > low or up < high):  # outward from the mode, by the ratios of neighbours
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(part_rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each part sends to each shard; lines add up to the parts and columns to the shards."""
    rng, lacking, matrix = np.random.default_rng(seed), list(sizes), []
    for rows in part_rows:
        line, left, rest = [], rows, sum(lacking)
        for s, lack in enumerate(lacking):
            rest -= lack
            n = left if s == len(lacking) - 1 else hypergeometric(rng, lack, rest, left)
            line.append(n)
            left -= n
        lacking = [a - b for a, b in zip(lacking, line, strict=True)]
        matrix.append(line)
    return matrix


def placed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` that tells each row from all others, and is the same in every scan however it is split."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    if "_metadata" not in {c.lower() for c in df.columns}:
        try:
            return df.withColumn(name, place)
        except AnalysisException:  # not rows as they stand in Parquet files
            pass
    own = unused(df, "_metadata_")[0]
    df = written(df.withColumnsRenamed({c: own for c in df.columns if c.lower() == "_metadata"}), "rows")
    return df.withColumn(name, place).withColumnRenamed(own, "_metadata")


def shuffled(df: DataFrame, identity: list[str], shards: int = 24, seed: int = 17, parts: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, from 0 without gaps in each shard)."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot") or c in identity]
    df = df.select(*kept)
    part, first, second, rank, cuts, cell, base, place, nth = unused(df, "_part", "_first", "_second", "_rank", "_cuts", "_block", "_base", "_place", "_nth")
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    parts = min(MAX_PARTS, parts)

    def key(n: int):
        return F.xxhash64(F.lit(seed + n), *identity, F.col(nth))

    keyed = placed(df, nth)
    keyed = keyed.withColumns({part: F.pmod(key(0), F.lit(parts)).cast("int"), first: key(1), second: key(2)}).drop(nth)
    rows = {r[0]: r[1] for r in keyed.groupBy(part).agg(F.count("*")).collect()}
    sizes = shard_sizes(sum(rows.values()), shards)
    matrix = communication_matrix([rows.get(p, 0) for p in range(parts)], sizes, seed)
    ends = [{"p": p, "e": np.cumsum(line).tolist()} for p, line in enumerate(matrix) if rows.get(p)]
    lines = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<p:int,e:array<long>>>")).alias("x")).select(F.col("x.p").alias(part), F.col("x.e").alias(cuts))

    def sent(table: DataFrame) -> DataFrame:
        order = F.row_number().over(Window.partitionBy(part).orderBy(first, second))
        shard = F.size(F.filter(cuts, lambda e: e < F.col(rank))).cast("int")
        return table.withColumn(rank, order).join(lines, part).withColumn("shard", shard).drop(part, first, rank, cuts)

    blocks = -(-max(sizes, default=0) // block_rows) or 1
    out = sent(keyed)
    if blocks == 1:
        slot = F.row_number().over(Window.partitionBy("shard").orderBy(second))
        return out.withColumn("slot", slot.cast("long") - 1).drop(second)
    block = F.floor(F.shiftrightunsigned(second, 33) * F.lit(blocks) / F.lit(1 << 31)).cast("int")
    sums = sent(keyed.select(part, first, second)).groupBy("shard", block.alias(cell)).agg(F.count("*").alias(place))
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", cell, F.coalesce(F.sum(place).over(before), F.lit(0)).alias(base))
    slot = F.row_number().over(Window.partitionBy("shard", cell).orderBy(second)) - 1
    found = out.withColumn(cell, block).withColumn(place, slot).join(bases, ["shard", cell])
    return found.withColumn("slot", F.col(base) + F.col(place)).drop(cell, place, base, second)

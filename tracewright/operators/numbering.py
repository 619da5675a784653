"""Dense numbers without a window over a whole table.

Rows are dealt by ranges of their order and written with their place in their
range; the counts of the ranges, added up, are what each range starts from. So
the only window is over one row for each range and group. The ranges are
written once and everything after reads what was written, so numbers stay whole
when executors come or go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], by: list[str] = (), rank: str = "rank", total: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``rank``: its rows' numbers from 0 without gaps, in ``order``, within each group ``by``; ``total`` is the rows of the group.

    Ties are in order of a hash of the whole row; rows that are equal throughout
    get the numbers of their places in any order, which makes no difference.
    Nulls come first and are a group of their own. ``by`` are names, and a
    column called like a result gives way to it. ``ranges`` is the number of
    tasks (default: ``spark.sql.shuffle.partitions``).
    """
    out = [c for c in df.columns if c.lower() not in {rank.lower(), (total or rank).lower()} or c in by]
    part, place, first, n, base, every = (f"_numbering_{x}" for x in ("part", "place", "first", "n", "base", "every"))
    tie = F.xxhash64(*map(_hashable, df.select(*out).schema))
    keys = [*(F.col(c).asc_nulls_first() for c in by), *order, tie]
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*out).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias(place)), "numbering")
    counts = dealt.groupBy(part, *by).agg(F.min(place).alias(first), F.count("*").alias(n))
    group = Window.partitionBy(*by)  # a row for each range, not for each row of the table
    starts = counts.withColumns({base: F.sum(n).over(group.orderBy(part)) - F.col(n), every: F.sum(n).over(group)})
    starts = starts.withColumnsRenamed({c: f"_numbering_by{k}" for k, c in enumerate(by)}).withColumnRenamed(part, part + "2")
    met = F.col(part) == F.col(part + "2")
    for k, c in enumerate(by):
        met &= F.col(c).eqNullSafe(F.col(f"_numbering_by{k}"))
    found = dealt.join(starts, met)
    more = [F.col(every).alias(total)] if total else []
    return found.select(*out, (F.col(base) + F.col(place) - F.col(first)).alias(rank), *more)


def _hashable(field) -> Column:
    """A column as it can be hashed: maps, and what may hold them, as text."""
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(F.col(f"`{field.name}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{field.name}`")

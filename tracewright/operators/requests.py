"""Model requests as tables: a content-addressed cache, and start times with a least interval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .numbering import numbered

#: Requests of which one task takes the running greatest.
BLOCK_ROWS = 1 << 16


def request_key(**parts: Column) -> Column:
    """SHA-256 of a request's parts as JSON in order of their names; what isn't given doesn't count."""
    return F.sha2(F.to_json(F.struct(*(parts[name].alias(name) for name in sorted(parts)))), 256)


def _cache(like: DataFrame, path: str) -> DataFrame:
    try:
        return like.sparkSession.read.schema("key string, text string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.sparkSession.createDataFrame([], "key string, text string")


def answered(requests: DataFrame, path: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``requests`` (``key`` and more) with ``text`` and ``hit``: whether the cache at ``path`` had the answer before.

    Keys that the cache lacks are answered once each, by ``answer`` (a row of
    ``requests`` for each key in, ``key, text`` out), and added to it; what is
    answered null is not kept, so it is asked again. A null key is never looked
    up nor answered. Of a key that two runs have added the least text counts.
    """
    requests = stored(requests, "requests")
    before = stored(_cache(requests, path).groupBy("key").agg(F.min("text").alias("text")), "cache")
    misses = requests.filter(F.col("key").isNotNull()).join(before.select("key"), "key", "left_anti").dropDuplicates(["key"])
    made = stored(answer(misses).select("key", "text").filter(F.col("text").isNotNull()), "answers")
    if not made.isEmpty():
        made.write.mode("append").parquet(path)
    known = before.withColumn("hit", F.lit(True)).unionByName(made.withColumn("hit", F.lit(False)))
    return requests.join(known, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def paced(requests: DataFrame, arrival: str, gap: int, tie: str) -> DataFrame:
    """``requests`` with ``start``: no earlier than ``arrival`` (a whole number), and ``gap`` after the start before it.

    In order of arrival (then ``tie``), start i is the greatest of a_j + (i - j) gap
    over all j up to i: a running greatest of a_j - j gap. It is taken within
    blocks of dense numbers, and the blocks' greatest ones are carried on, so no
    task sees more than a block. Rows without an arrival come first and start at
    once without holding up others.
    """
    waiting = requests.filter(F.col(arrival).isNotNull())
    ranked = numbered(waiting, [F.col(arrival), F.col(tie)], rank="_rank")
    ranked = stored(ranked.withColumns({"_block": F.expr(f"_rank div {BLOCK_ROWS}"), "_free": F.col(arrival).cast("long") - F.col("_rank") * gap}), "paced")
    tops = ranked.groupBy("_block").agg(F.max("_free").alias("_top"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    carried = tops.select("_block", F.max("_top").over(earlier).alias("_carried"))
    within = Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    start = F.greatest(F.max("_free").over(within), F.col("_carried")) + F.col("_rank") * gap
    out = ranked.join(carried, "_block").withColumn("start", start).select(*requests.columns, "start")
    return out.unionByName(requests.filter(F.col(arrival).isNull()).withColumn("start", F.lit(None).cast("long")))

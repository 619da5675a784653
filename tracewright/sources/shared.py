"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return _OWN[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    path = f"{folder(df.sparkSession)}/tracewright/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores dealt over all cores, before heavy work on each row; larger inputs are left as they are.

    For tables as they are read only: asking a plan with shuffles for its
    partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bits of a membership filter.
FILTER_BITS = 1 << 23


class Membership:
    """Bits of the values of one long column; tells which rows of another table may hold one of them.

    A row that is out holds none of them, and a row that is in mostly does; so
    few rows are shuffled by an exact join. The bits are at most
    ``FILTER_BITS / 64`` words however many values there are, so they are
    broadcast; very many values let every row through to the exact join.
    """

    def __init__(self, keys: DataFrame):
        self.name = keys.columns[0]
        self.keys = keys
        bits = keys.select(F.shiftright(self._place(F.col(self.name)), 6).alias("filter_word"), F.call_function("shiftleft", F.lit(1).cast("long"), self._bit(F.col(self.name))).alias("bit"))
        self.words = stored(bits.groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits")).coalesce(1), "filter")

    def _place(self, column: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(3), column), 64 - (FILTER_BITS.bit_length() - 1))

    def _bit(self, column: Column) -> Column:
        return self._place(column).bitwiseAND(F.lit(63)).cast("int")

    def maybe(self, df: DataFrame, how: str = "left_semi") -> DataFrame:
        """Rows whose column of the same name may be among the values; with ``left_anti`` the others."""
        column = F.col(self.name)
        met = (F.shiftright(self._place(column), 6) == F.col("filter_word")) & (F.getbit("filter_bits", self._bit(column)) == 1)
        return df.join(F.broadcast(self.words), met, how)

    def within(self, df: DataFrame) -> DataFrame:
        return self.maybe(df).join(self.keys, self.name, "left_semi")

    def without(self, df: DataFrame) -> DataFrame:
        return self.maybe(df, "left_anti").unionByName(self.maybe(df).join(self.keys, self.name, "left_anti"))

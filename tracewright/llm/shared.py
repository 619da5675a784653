"""Tables and files in the folder that driver and executors share.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it
again, so a lost executor never takes the only copy of an intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; without one, a folder of our own where all runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tracewright-")
    return "file://" + _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tracewright/{label}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch that carries whole texts.
TEXT_ROWS = 128


def written(df: DataFrame, label: str, texts: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    With ``texts``, Python gets batches of at most ``TEXT_ROWS`` rows while it
    is written, so long texts don't fill a worker's memory.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    # the driver keeps the plan of every query as text, and here are many queries
    wanted = {"spark.sql.maxPlanStringLength": "4096"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXT_ROWS)} if texts else {})
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewright_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_tracewright_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hadoop = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of a membership filter.
FILTER_BITS = 1 << 23


def membership(keys: DataFrame):
    """Splits a table by whether a long column may be among ``keys`` (one long column): ``inside(df, column)`` and ``outside(df, column)``.

    What is outside is none of them; what is inside mostly is. It spares most
    rows a shuffle before an exact join. The filter is a table of at most
    ``FILTER_BITS / 64`` words whatever the number of keys, so it is broadcast;
    with very many keys it lets every row through to the exact join.
    """

    def place(column):
        return F.shiftrightunsigned(F.xxhash64(F.lit(3), column), 64 - (FILTER_BITS.bit_length() - 1))

    def bit_of(column):
        return place(column).bitwiseAND(F.lit(63)).cast("int")

    key = F.col(keys.columns[0])
    bits = keys.select(F.shiftright(place(key), 6).alias("filter_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit_of(key)).alias("bit"))
    words = written(bits.groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits")).repartition(1), "filter")

    def split(df: DataFrame, column, how: str) -> DataFrame:
        met = (F.shiftright(place(column), 6) == words["filter_word"]) & (F.getbit(words["filter_bits"], bit_of(column)) == 1)
        return df.join(F.broadcast(words), met, how)

    return lambda df, column: split(df, column, "left_semi"), lambda df, column: split(df, column, "left_anti")

"""Streams: resumable generation and the trailing-hour rate limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resumable(spark: SparkSession, plan_path: str, plan_schema: str, make: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str, files_per_run: int | None = None) -> int:
    """Run a plan folder through ``make`` into ``out_path``; a later call goes on where this one ended.

    The checkpoint holds what was read. A batch that is written again after a
    crash has the same number and overwrites its own folder, so no row doubles.
    Returns the number of batches.
    """
    stream = spark.readStream.schema(plan_schema).option("maxFilesPerTrigger", files_per_run or 1000).parquet(plan_path)
    done = []

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def rate_limited(requests: DataFrame, key: str, at: str, most: int = 20, hours: int = 1) -> DataFrame:
    """Streaming form of the trailing window: ``key, at, recent, rejected`` of every request; refused ones count too.

    A request is refused when the ``most`` requests before it are within the
    window too, so the last ``most`` times are all the state of a key, however
    many requests it sends, and a request costs one step. ``recent`` counts the
    requests within the window, itself included, up to ``most`` + 1, which
    stands for any number over ``most``. The state is dropped when the
    watermark has passed its last time.
    """
    span = hours * 3600.0

    def run(group, batches, state):
        last = deque(state.get[0] if state.exists else (), maxlen=most)
        if state.hasTimedOut:
            state.remove()
            return
        # one group's rows of a trigger, in batches: times only, since order matters across batches
        times = np.sort(np.concatenate([pdf[at].to_numpy() for pdf in batches]))
        name = group[0]
        for start in range(0, len(times), 1 << 16):
            part, recent = times[start : start + (1 << 16)], []
            for now in (part.astype("datetime64[us]").astype(np.int64) / 1e6).tolist():
                while last and now - last[0] >= span:
                    last.popleft()
                recent.append(len(last) + 1)
                last.append(now)
            yield pd.DataFrame({key: [name] * len(part), at: part, "recent": recent, "rejected": [r > most for r in recent]})
        state.update((list(last),))
        state.setTimeoutTimestamp(int((last[-1] + span) * 1000) + 1)

    stamped = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{hours} hours")
    kind = dict(requests.dtypes)[key]
    return stamped.select(key, at).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {at} timestamp, recent long, rejected boolean", "times array<double>", "append", "EventTimeTimeout")


def windowed(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts per key in tumbling windows with late data."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")

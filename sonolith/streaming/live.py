"""Live input: windows over a stream of band levels, and an adaptive threshold with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def band_windows(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Levels of each band (key) in tumbling windows of event time; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if events.isStreaming else timed
    return marked.groupBy(F.window("ts", width).alias("w"), "band").agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("total"), F.max("level").alias("peak")).select(F.col("w.start").alias("start"), "band", "n", "total", "peak")


def onsets(events: DataFrame, factor: float = 1.5, memory: float = 0.9) -> DataFrame:
    """Rows (band, i, level) whose rise above the one before exceeds factor times its running mean: the state of a band
    is its last level and the mean, so a stream gives the same onsets however it is cut into micro-batches, as long as
    a band's rows come in their order from one to the next. A worker holds a band's rows of one micro-batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, mean = state.get if state.exists else (None, 0.0)
        out = []
        rows = pd.concat([frame[["i", "level"]] for frame in frames]).sort_values("i")  # chunks come in any order
        for i, level in rows.itertuples(index=False):
            rise = max(0.0, level - last) if last is not None else 0.0
            if last is not None and rise > factor * mean and rise > 0:
                out.append((key[0], int(i), float(level)))
            last, mean = float(level), memory * mean + (1 - memory) * rise
        state.update((last, mean))
        yield pd.DataFrame(out, columns=["band", "i", "level"])

    return events.groupBy("band").applyInPandasWithState(step, "band string, i long, level double", "last double, mean double", "append", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process what a stream has now, into a table in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

"""Structured Streaming: event relations as a stream, and incremental views of them.

Watermarks bound the state; late rows beyond them are dropped, as Spark defines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RELATIONS = "event_id string, activity string, ts timestamp, object_id string, object_type string"
PAIRS = "object_type string, src_activity string, dst_activity string, gap double"


def read_relations(spark: SparkSession, path: str, lateness: str = "1 hour") -> DataFrame:
    """A stream of Parquet files with one row for each event and object."""
    return spark.readStream.schema(RELATIONS).parquet(path).withWatermark("ts", lateness)


def windowed_activity(stream: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and approximate distinct objects of each activity in time windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.groupBy(window, "activity").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("object_id").alias("n_objects"))


def directly_follows(stream: DataFrame) -> DataFrame:
    """Directly-follows pairs of every object as they arrive; the state is each object's last event.

    The rows of an object in one micro-batch are put in time order as a whole, however many
    Arrow batches they come in, so ``maxFilesPerTrigger`` bounds the memory of a hot object. An
    object silent past the watermark is forgotten.
    """

    def step(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for row in pd.concat(batches).sort_values(["ts", "event_id"]).itertuples(index=False):
            now = row.ts.value // 1000
            if last is not None:
                out.append((key[0], last[0], row.activity, (now - last[1]) / 1e6))
            last = (row.activity, now)
        state.update(last)
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last[1] // 1000) + 86_400_000)
        yield pd.DataFrame(out, columns=["object_type", "src_activity", "dst_activity", "gap"])

    keyed = stream.select("object_type", "object_id", "ts", "event_id", "activity").groupBy("object_type", "object_id")
    return keyed.applyInPandasWithState(step, PAIRS, "activity string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def monitor(stream: DataFrame, check, checkpoint: str, interval: str | None = "10 seconds"):
    """Run a batch check ``(DataFrame, batch id)`` on every micro-batch; without an interval, on what is there, then end."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(check).start()

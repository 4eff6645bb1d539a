"""Activity over a stream: tumbling buckets with late data, and appending what is new."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.buckets import seconds_of
from ..shared import shared_path

#: Window specs; weeks begin on Monday.
WINDOWS = {"day": ("1 day", None, None), "week": ("7 days", "7 days", "4 days")}


def event_buckets(events: DataFrame, size: str = "day", late: str = "2 days") -> DataFrame:
    """Events and their value per tumbling window and type; a streaming or a batch frame."""
    length, slide, offset = WINDOWS[size]
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    window = F.window("at", length, slide, offset) if offset else F.window("at", length)
    rows = stamped.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.count_if(F.col("value") > 50).alias("large"))
    return rows.select(F.unix_timestamp("w.start").alias("bucket_start"), "event_type", "events", "large")


def _totals(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One user's new events on top of the totals so far."""
    events, total, first, last = state.get if state.exists else (0, 0.0, None, None)
    for frame in frames:
        events, total = events + len(frame), total + float(frame["value"].fillna(0).sum())
        low, high = int(frame["at"].min()), int(frame["at"].max())
        first, last = low if first is None else min(first, low), high if last is None else max(last, high)
    state.update((events, total, first, last))
    yield pd.DataFrame({"user_id": [key[0]], "events": [events], "total": [total], "first_at": [first], "last_at": [last]})


def user_totals(events: DataFrame) -> DataFrame:
    """Per user the events, their value, and unix seconds of the first and the last, kept as state: a stream of updates."""
    rows = events.select("user_id", "value", seconds_of(F.col("ts")).alias("at"))
    schema = "user_id long, events long, total double, first_at long, last_at long"
    return rows.groupBy("user_id").applyInPandasWithState(_totals, schema, "events long, total double, first_at long, last_at long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str = "complete", on_progress: Callable[[dict[str, Any]], None] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what its sink holds: everything, in complete mode, else all that was told.

    In append and update mode events later than the watermark are dropped. `on_progress` is told of each batch:
    its number, its rows, the rows dropped for being late, and the rows held as state.
    """
    spark = stream.sparkSession
    name = f"activity_{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    for batch in query.recentProgress if on_progress else ():
        states = batch["stateOperators"]
        on_progress({
            "batch": batch["batchId"], "rows": batch["numInputRows"], "late": sum(s["numRowsDroppedByWatermark"] for s in states),
            "state": sum(s["numRowsTotal"] for s in states),
        })
    return spark.table(name)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet file or folder at `path`, with the schema that it has now.

    The path is given as a pattern of itself, for a stream takes any other to be a folder.
    """
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")

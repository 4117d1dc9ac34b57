"""Structured Streaming twins of the event operators.

Each streaming function has a batch twin with the same result once all input is
read; the horizon of deduplication is the watermark, which a batch doesn't need.
State lives in the RocksDB store where the session has it configured.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from litmusq.plans.lineage import reserved

#: How late an event may come after the latest seen.
DELAY = "30 days"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table folder or file as a stream; new files are picked up.  Times without a zone are taken as the session's."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path + ("" if Path(path).is_dir() else "*"))
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def deduplicated(events: DataFrame, key: str, time: str, delay: str = DELAY) -> DataFrame:
    """Idempotent ingestion: an event id counts once within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def routed(events: DataFrame, kind: str, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events of known kinds, dead letters); a null kind is a dead letter."""
    ok = F.coalesce(F.col(kind).isin(known), F.lit(False))
    return events.where(ok), events.where(~ok)


def matched(events: DataFrame, accounts: DataFrame, key: str) -> DataFrame:
    """Stream to static join; an event without its account is kept and marked, never buffered."""
    return events.join(accounts.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Counts per tumbling or sliding window and kind.  An extension beyond the event operators."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), "event_type", "n")


def sessions(events: DataFrame, time: str, gap: str, delay: str = DELAY) -> DataFrame:
    """Events of a user with no longer pause than the gap.  An extension."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("starts"), "n")


def folded(events: DataFrame, key: str, order: str, to: str, start: str, allowed: dict[str, list[str]]) -> DataFrame:
    """State machine per key: each micro-batch applies its events in order and emits the state reached."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, applied, rejected = state.get if state.exists else (start, 0, 0)
        for row in pd.concat(list(frames)).sort_values(order)[to]:
            if row in allowed.get(now, ()):
                now, applied = row, applied + 1
            else:
                rejected += 1
        state.update((now, applied, rejected))
        yield pd.DataFrame({key: [k[0]], "state": [now], "applied": [applied], "rejected": [rejected]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string, applied int, rejected int", "state string, applied int, rejected int", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives the result as a table.

    ``root`` is the folder of the checkpoint; else it is made in the shared
    folder of the session and goes with its tables.
    """
    spark = stream.sparkSession
    root = root or reserved(spark, "stream")
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)

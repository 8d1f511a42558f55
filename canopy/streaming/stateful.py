"""Streaming counterparts of stateful collections, and event-time windows; an extension, with the semantics of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums of value in windows of event time; rows later than ``late`` behind the newest are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", at: str = "ts", by: str = "user_id") -> DataFrame:
    """Counts in sessions that end after a gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n"))


def queues(log: DataFrame) -> DataFrame:
    """id, seq, value of each dequeue of a stream of operations (id string, seq long, op, value); a queue's rest is its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out, at = [], 0
        for frame in frames:
            for seq, op, value in frame.sort_values("seq")[["seq", "op", "value"]].itertuples(index=False):
                if op == "push":
                    held.append(value)
                elif at < len(held):
                    out.append((key[0], seq, held[at]))
                    at += 1
        state.update((held[at:],))
        yield pd.DataFrame(out, columns=["id", "seq", "value"])

    return log.groupBy("id").applyInPandasWithState(step, "id string, seq long, value string", "held array<string>", "append", "NoTimeout")


def lines(spark, folder: str) -> DataFrame:
    """A folder's text files as a stream of lines."""
    return spark.readStream.format("text").load(folder)


def socket_lines(spark, host: str, port: int) -> DataFrame:
    """Lines from a TCP connection."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()

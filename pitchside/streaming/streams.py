"""Streaming operators: daily counts, duplicate suppression, latest values, rolling state, expiry."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def operational_days(stream: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Rows of each day that begins at seven, final once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "24 hours", "24 hours", "7 hours").alias("day")).count()


def without_near_duplicates(stream: DataFrame, time: str, keys: list[str], within: str = "15 minutes") -> DataFrame:
    """The first row of a key; repeats within the watermark's delay are dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def latest_values(stream: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """The latest value of each key, for update or complete mode."""
    return stream.groupBy(*keys).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def rolling_state(stream: DataFrame, key: str, time: str, value: str, size: int = 20) -> DataFrame:
    """Each row with the mean of its key's values before it, kept in keyed state of at most size values.

    Rows of one batch are taken in order of time; a batch's rows follow those of earlier batches.
    """

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        means, n = [], []
        for v in rows[value]:
            means.append(sum(kept) / len(kept) if kept else None)
            n.append(len(kept))
            kept = [*kept, float(v)][-size:]
        state.update((kept,))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "at": rows[time].to_numpy(), "value": rows[value].to_numpy(), "mean_before": pd.array(means, "Float64").to_numpy(float, na_value=float("nan")), "n_before": n})

    return stream.groupBy(key).applyInPandasWithState(
        step, "key long, at timestamp, value double, mean_before double, n_before long", "kept array<double>", "append", GroupStateTimeout.NoTimeout
    )


def expired(bets: DataFrame, time: str, now: Any, minutes: int = 60) -> DataFrame:
    """Pending rows that are too old, for a micro-batch (foreachBatch) or a table."""
    age = F.lit(now).cast("timestamp") - F.expr(f"interval {minutes} minutes")
    return bets.where((F.col("status") == "PENDING") & (F.col(time) <= age)).withColumn("status", F.lit("VOID"))

"""Streaming operators with keyed state and event-time timers: values in breaks, expiry, digests.

The session needs the RocksDB state store (STATE_STORE); timers fire once the watermark has passed them,
so a key gets its row though nothing more comes for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pitchside.functions import registry as G
from pitchside.operators.upkeep import digest

#: The setting that timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What is known of a match: all columns of its latest state row.
MATCH = "sport string, prior double, home int, away int, clock double, state string, stats map<string,double>"
BREAKS = ("HT", "BREAK")
#: Minutes until a pending bet expires, by ledger, and days after which a result is late.
EXPIRY = {"REAL": 60, "PAPER": 4 * 24 * 60}
LATE_DAYS = 3


def _millis(t: pd.Timestamp) -> int:
    return pd.Timestamp(t).value // 1_000_000


def _match_rows(key: Any, rows: list[tuple]) -> pd.DataFrame:
    at, match, odds = zip(*rows, strict=True)
    return pd.DataFrame({"match_id": [key[0]] * len(rows), "at": pd.to_datetime(list(at), unit="ms"), "match": list(match), "odds": pd.Series(odds, dtype=float)})


class _Break(StatefulProcessor):
    """Rows of one match: what is known at so many seconds into a break, and at each price after that."""

    def __init__(self, breaks: tuple[str, ...], seconds: int):
        self.breaks, self.wait = breaks, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "state string, since long, row string")
        self.price = handle.getValueState("price", "odds double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, since, match = self.known.get() if self.known.exists() else (None, 0, None)
        odds = self.price.get()[0] if self.price.exists() else None
        timers = [*self.handle.listTimers()]
        due = timers[0] if timers else None
        out: list[tuple] = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            at = _millis(r.at)
            if due is not None and due < at:  # its timer would fire later, with what comes now
                out.append((due, match, odds))
                due = None
            if r.match is not None and not pd.isna(r.match):
                if r.state != state:
                    since, due = at, at + self.wait if r.state in self.breaks else None
                state, match = r.state, r.match
            if not pd.isna(r.odds):
                odds = float(r.odds)
                if state in self.breaks and at - since > self.wait:
                    out.append((at, match, odds))
        for t in timers:
            self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(due)
        if match is not None:
            self.known.update((state, since, match))
        if odds is not None:
            self.price.update((odds,))
        if out:
            yield _match_rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        odds = self.price.get()[0] if self.price.exists() else None
        yield _match_rows(key, [(expiredTimerInfo.getExpiryTimeInMs(), self.known.get()[2], odds)])

    def close(self) -> None:
        pass


def live_values(states: DataFrame, prices: DataFrame, breaks: tuple[str, ...] = BREAKS, seconds: int = 120, late: str = "10 seconds") -> DataFrame:
    """The value of the home side of every match that has been in a break for so many seconds: match_id, at and value().

    states: match_id, at and MATCH, a row for each change; prices: match_id, at, odds. A match gives a
    row when its break is so old, by a timer, and another for each price until the break ends. A match
    without a price, an unknown sport or a prior out of range gives none.
    """
    names = [x.split(" ")[0] for x in MATCH.split(", ")]
    own = states.select("match_id", "at", "state", F.to_json(F.struct(*names)).alias("match"), F.lit(None).cast("double").alias("odds"))
    offers = prices.select("match_id", "at", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("match"), F.col("odds").cast("double").alias("odds"))
    kind = states.schema["match_id"].dataType.simpleString()
    both = own.unionByName(offers).withWatermark("at", late)
    rows = both.groupBy("match_id").transformWithStateInPandas(_Break(breaks, seconds), f"match_id {kind}, at timestamp, match string, odds double", "Append", "EventTime")
    # generators part the steps: a model names a field often, and in one projection each name would read the text again
    known = rows.select("match_id", "at", "odds", F.inline(F.array(F.from_json("match", MATCH))))
    value = G.live_value(*[F.col(c) for c in ("sport", "prior", "home", "away", "clock", "odds", "stats")])
    return known.select("match_id", "at", F.inline(F.array_compact(F.array(value))))


class _Expiry(StatefulProcessor):
    """Rows of one bet: what becomes of it, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bet = handle.getValueState("bet", "placed long, outcome string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        placed, outcome = self.bet.get() if self.bet.exists() else (None, None)
        timers = [*self.handle.listTimers()]
        due = timers[0] if timers else None
        out: list[tuple] = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            at = _millis(r.at)
            if due is not None and due < at:  # its timer would fire after this row
                outcome = "expired"
                out.append((due, "VOID", outcome))
                due = None
            if r.status == "PENDING":
                if placed is None:
                    placed, due = at, at + EXPIRY[r.ledger] * 60_000
            elif placed is not None and outcome is None:
                outcome, due = "settled", None
                out.append((at, r.status, outcome))
            elif placed is None or at - placed > LATE_DAYS * 86_400_000:
                out.append((at, r.status, "late"))
        for t in timers:
            self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(due)
        if placed is not None:
            self.bet.update((placed, outcome))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.bet.update((self.bet.get()[0], "expired"))
        yield self._rows(key, [(expiredTimerInfo.getExpiryTimeInMs(), "VOID", "expired")])

    def _rows(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        at, status, outcome = zip(*rows, strict=True)
        return pd.DataFrame({"bet_id": [key[0]] * len(rows), "at": pd.to_datetime(list(at), unit="ms"), "status": status, "outcome": outcome})

    def close(self) -> None:
        pass


def expiring(bets: DataFrame, late: str = "1 minute") -> DataFrame:
    """bet_id, at, status and outcome of a stream of bets and results (bet_id, ledger, status, at).

    A pending bet that has no result EXPIRY minutes after it was placed is void (expired), by a timer.
    A result in time settles it; one more than LATE_DAYS after the bet, or without a bet, is late; any
    other that comes after the end of a bet gives nothing. A bet's second PENDING row changes nothing.
    """
    kind = bets.schema["bet_id"].dataType.simpleString()
    rows = bets.select("bet_id", "ledger", "status", "at").where(F.col("ledger").isin(*EXPIRY)).withWatermark("at", late)
    return rows.groupBy("bet_id").transformWithStateInPandas(_Expiry(), f"bet_id {kind}, at timestamp, status string, outcome string", "Append", "EventTime")


def store_batch(batch: DataFrame, number: int, path: str, part: str = "batch") -> None:
    """A micro-batch as the partition of its number: a batch that is run again takes its own place."""
    batch.withColumn(part, F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def routed(stream: DataFrame, by: Column, paths: dict[bool, str], checkpoint: str) -> None:
    """Runs a stream over what is there now: rows where by holds go to paths[True], the others, a side output, to paths[False]."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for to, path in paths.items():
            store_batch(batch.where(F.coalesce(by, F.lit(False)) == to), number, path)
        batch.unpersist()

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def digest_batch(batch: DataFrame, number: int, path: str, at: str, text: str, most: int = 500, single: int = 2) -> None:
    """The digest messages of a micro-batch, stored by its number."""
    store_batch(digest(batch, at, text, most, single), number, path)


def digests(stream: DataFrame, path: str, checkpoint: str, at: str, text: str, most: int = 500, single: int = 2) -> None:
    """Runs a stream of alerts over what is there now; each batch is stored as its digest, once however often it is run."""
    run = lambda batch, number: digest_batch(batch, number, path, at, text, most, single)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

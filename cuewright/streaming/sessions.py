"""Ordered sessions: a gate that refuses without moving on, mode resets, bursts; batch and stream alike.

Streams keep a small state per session. With a time column its watermark bounds that state: rows
later than it are dropped by Spark, and a session without rows for ``KEEP_MS`` of event time
starts anew. Without a time column state is kept for as long as the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GATE = "session_id long, unit_index long, revision long, event_id long, accepted boolean"
STATE = "next long, revision long"
BURSTS = "session_id long, tokens array<int>"
#: Event time after which a silent session's state goes.
KEEP_MS = 24 * 3600 * 1000


def gate_rows(g: pd.DataFrame, at: int, revision: int) -> tuple[pd.DataFrame, int, int]:
    """Accept a unit iff its index is the next one and its revision does not fall; others change nothing."""
    ok = []
    for i, r in zip(g["unit_index"].tolist(), g["revision"].tolist()):
        good = i == at and r >= revision
        if good:
            at, revision = at + 1, r
        ok.append(good)
    out = g[["session_id", "unit_index", "revision", "event_id"]].copy()
    out["accepted"] = ok
    return out, at, revision


def _gated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The gate over a sorted partition; (session, next, revision) are carried from batch to batch."""
    session, at, revision = None, 0, 0
    for b in batches:
        s = b["session_id"].to_numpy()
        cut = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1, len(s)] if len(s) else [0]
        for lo, hi in zip(cut, cut[1:]):
            if s[lo] != session:
                session, at, revision = s[lo], 0, 0
            out, at, revision = gate_rows(b.iloc[lo:hi], at, revision)
            yield out


def gate_batch(units: DataFrame) -> DataFrame:
    """The gate over a table, each session in the order of event_id.

    Sessions are dealt by hash and sorted by Spark, so a long session is read batch by batch and
    only two numbers are held. Units whose revision or index is null are refused.
    """
    x = units.select("session_id", "unit_index", "revision", "event_id")
    return x.repartition("session_id").sortWithinPartitions("session_id", "event_id").mapInPandas(_gated, GATE)


def _by_session(rows: DataFrame, cols: list[str], step, first: tuple, out: str, state: str, time_col: str | None, late: str) -> DataFrame:
    """State per session over a stream: ``step(session, sorted rows, state)`` gives (rows out, next state).

    Rows of a micro-batch are taken by event_id. State expires by event time where there is a time column.
    """

    def run(key, batches, s: GroupState):
        if s.hasTimedOut:
            s.remove()
            return
        part = pd.concat(list(batches)).sort_values("event_id")
        got, nxt = step(key[0], part, s.get if s.exists else first)
        s.update(nxt)
        if time_col:
            newest = int(part["at_ms"].max())
            s.setTimeoutTimestamp(max(newest, s.getCurrentWatermarkMs()) + KEEP_MS)
        yield got

    x = rows
    if time_col:
        x = x.withWatermark(time_col, late).select(*cols, F.unix_millis(F.col(time_col)).alias("at_ms"), time_col)
    else:
        x = x.select(*cols)
    mode = GroupStateTimeout.EventTimeTimeout if time_col else GroupStateTimeout.NoTimeout
    return x.groupBy("session_id").applyInPandasWithState(run, out, state, "append", mode)


def gate_stream(units: DataFrame, time_col: str | None = None, late: str = "1 hour") -> DataFrame:
    """The gate over a stream; state per session is two numbers."""

    def step(session, rows, state):
        out, at, revision = gate_rows(rows, *state)
        return out, (at, revision)

    return _by_session(units, ["session_id", "unit_index", "revision", "event_id"], step, (0, 0), GATE, STATE, time_col, late)


def mode_stream(units: DataFrame, time_col: str | None = None, late: str = "1 hour") -> DataFrame:
    """Decoder resets: (session_id, event_id) where silence turns to speech; state is the last mode."""

    def step(session, rows, state):
        speech = rows["speech"].fillna(False).to_numpy(dtype=bool)
        was = np.r_[state[0], speech[:-1]]
        hit = rows["event_id"].to_numpy()[speech & ~was]
        return pd.DataFrame({"session_id": np.full(len(hit), session), "event_id": hit}).astype({"session_id": "int64", "event_id": "int64"}), (bool(speech[-1]),)

    return _by_session(units, ["session_id", "event_id", "speech"], step, (False,), "session_id long, event_id long", "active boolean", time_col, late)


def burst_stream(bursts: DataFrame, end: int = 1, time_col: str | None = None, late: str = "1 hour") -> DataFrame:
    """Whole events from token bursts (session_id, event_id, tokens), of any length; state is what has no end yet.

    Tokens whose end never comes go with the session's state, as they give no row in the batch form.
    """

    def step(session, rows, state):
        pending, done = list(state[0]), []
        for tokens in rows["tokens"]:
            for t in tokens if tokens is not None else ():
                pending.append(int(t))
                if t == end:
                    done.append(pending)
                    pending = []
        return pd.DataFrame({"session_id": pd.Series([session] * len(done), dtype="int64"), "tokens": done}), (pending,)

    return _by_session(bursts, ["session_id", "event_id", "tokens"], step, ([],), BURSTS, "pending array<int>", time_col, late)


def first_units(units: DataFrame, time_col: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of repeated units, with state bounded by a watermark."""
    return units.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


RECEIPTS = "session_id long, unit_index long, revision long, event_id long, accepted boolean, reason string"


def receipt_rows(g: pd.DataFrame, at: int, revision: int) -> tuple[pd.DataFrame, int, int]:
    """Every unit of sorted rows with its receipt, and the state after them.

    A unit is refused as ``repeated`` below the next index, ``gap`` above it, ``revision`` where that falls, ``actuation`` where
    the column ``actuated`` says that its action was not taken; only an accepted unit moves the state. Nulls are refused.
    """
    why = []
    for i, r, done in zip(g["unit_index"].tolist(), g["revision"].tolist(), g["actuated"].tolist()):
        bad = "gap" if i is None or i != i or i > at else "repeated" if i < at else "revision" if r is None or r != r or r < revision else None if done is True else "actuation"
        if bad is None:
            at, revision = at + 1, int(r)
        why.append(bad)
    out = g[["session_id", "unit_index", "revision", "event_id"]].copy()
    return out.assign(accepted=[x is None for x in why], reason=pd.Series(why, index=out.index, dtype=object)), at, revision


class OrderedUnits(StatefulProcessor):
    """Two numbers a session, in a value state; a timer at the end of a session's silence clears them."""

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("at", "next long, revision long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        part = pd.concat(list(rows)).sort_values("event_id")
        at, revision, timer = self.state.get() if self.state.exists() else (0, 0, 0)
        out, at, revision = receipt_rows(part, at, revision)
        ends = max(int(part["at_ms"].max()), timerValues.getCurrentWatermarkInMs(), timer - self.keep_ms) + self.keep_ms
        if ends != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
        self.state.update((at, revision, ends))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def receipts_stream(units: DataFrame, time_col: str, late: str = "1 hour", keep_ms: int = KEEP_MS) -> DataFrame:
    """Receipts of units of a stream: accepted and refused ones both leave it, with the reason.

    ``units`` has session_id, unit_index, revision, event_id, actuated and a time column. Rows of a micro-batch are taken by
    event_id; rows later than the watermark are dropped by Spark, and a session silent for ``keep_ms`` of event time starts anew.
    The state lies in RocksDB, which Spark needs for value states and timers.
    """
    spark = units.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = units.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).select("session_id", "unit_index", "revision", "event_id", "actuated", time_col, F.unix_millis(F.col(time_col)).alias("at_ms"))
    return x.groupBy("session_id").transformWithStateInPandas(OrderedUnits(keep_ms), RECEIPTS, "append", "eventTime")


def receipts_batch(units: DataFrame) -> DataFrame:
    """The receipts over a table, each session in the order of event_id, read batch by batch."""

    def run(batches):
        session, at, revision = None, 0, 0
        for b in batches:
            s = b["session_id"].to_numpy()
            cut = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1, len(s)] if len(s) else [0]
            for lo, hi in zip(cut, cut[1:]):
                if s[lo] != session:
                    session, at, revision = s[lo], 0, 0
                out, at, revision = receipt_rows(b.iloc[lo:hi], at, revision)
                yield out

    x = units.select("session_id", "unit_index", "revision", "event_id", "actuated")
    return x.repartition("session_id").sortWithinPartitions("session_id", "event_id").mapInPandas(run, RECEIPTS)


def unit_receipt_rows(units: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Every unit with ``accepted``: the first row of its keys by ``order``; later ones are refused as duplicates."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return units.withColumn("accepted", n == 1)


def clock_buckets(units: DataFrame, time_col: str, tick: str, late: str, *keys: str) -> DataFrame:
    x = units.withWatermark(time_col, late).groupBy(F.window(time_col, tick).alias("w"), *keys).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("tick"), *keys, "n")


def unit_receipts(controls: DataFrame, violation: str, ordinal: str, *keys: str) -> DataFrame:
    """Per unit: accepted iff no control breaks a rule; the first one in order names the reason."""
    g = controls.groupBy(*keys).agg(F.min_by(violation, F.when(F.col(violation).isNotNull(), F.col(ordinal))).alias("reason"), F.count("*").alias("n_controls"))
    return g.withColumn("accepted", F.col("reason").isNull())

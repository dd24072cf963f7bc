"""Keyed state machines for Structured Streaming.

Each operator takes a streaming frame and gives one; per key only a small record is kept. Rows of one
micro-batch are taken in the order of their times. Times are microseconds of the events themselves,
so that a replay gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.steps import shared_dir

#: Microseconds of silence before a node is offline, and that a finding must last, or be gone, to be told.
OFFLINE, OPEN_AFTER, RESOLVE_AFTER, REMIND_AFTER = 45_000_000, 120_000_000, 300_000_000, 24 * 3_600_000_000
RANKS = {"info": 0, "warning": 1, "critical": 2}
TERMINAL = {"succeeded", "failed", "expired", "cancelled"}
Step = Callable[[tuple, Any], tuple[tuple, list[tuple]]]
Ring = Callable[[tuple, int], tuple[tuple, list[tuple]]]


def keyed(stream: DataFrame, key: str, order: list[str], start: tuple, state: str, output: str, step: Step) -> DataFrame:
    """``step`` folded over the rows of each key: it takes the state and a row and gives the new state and rows to emit."""

    def fold(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        columns = [c.strip().split(" ")[0] for c in output.split(",")]
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out: list[tuple] = []
        for row in rows.itertuples(index=False):
            now, told = step(now, row)
            out += [(name[0], *x) for x in told]
        held.update(now)
        if out:
            yield pd.DataFrame(out, columns=columns)

    return stream.groupBy(key).applyInPandasWithState(fold, output, state, "append", GroupStateTimeout.NoTimeout)


def timed(stream: DataFrame, key: str, order: list[str], start: tuple, state: str, output: str, step: Step, due: Callable[[tuple], int | None], ring: Ring, delay: str) -> DataFrame:
    """Like ``keyed``, with a timer: at the time that ``due`` gives for a state (None: never), ``ring`` is called with it.

    The clock is that of the events: a row of its key or, for keys that are silent, the watermark,
    which follows the newest ``at_time`` by ``delay``. Cuts into micro-batches change no row that is told.
    """

    def fold(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        columns = [c.strip().split(" ")[0] for c in output.split(",")]
        out: list[tuple] = []

        def ringing(before: int) -> None:
            nonlocal now
            while (at := due(now)) is not None and at < before:
                now, told = ring(now, at)
                out.extend((name[0], *x) for x in told)

        if not held.hasTimedOut:
            for row in pd.concat(list(frames)).sort_values(order, kind="stable").itertuples(index=False):
                ringing(int(row.at_time))
                now, told = step(now, row)
                out.extend((name[0], *x) for x in told)
        clock = held.getCurrentWatermarkMs()
        ringing(clock * 1000)
        held.update(now)
        at = due(now)
        if at is not None:
            held.setTimeoutTimestamp(max(at // 1000, clock) + 1)
        if out:
            yield pd.DataFrame(out, columns=columns)

    clocked = stream.withColumn("clock", F.timestamp_micros("at_time")).withWatermark("clock", delay)
    return clocked.groupBy(key).applyInPandasWithState(fold, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def rates(stream: DataFrame) -> DataFrame:
    """Rate of each sample of a counter (ST3): null for the first one, after a reset or without time between."""

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        total, at, seen = state
        seconds, more = (row.at_time - at) / 1e6, row.total - total
        rate = int(more / seconds * 10 + 0.5) / 10 if seen and more >= 0 and seconds > 0 else None
        return (int(row.total), int(row.at_time), True), [(int(row.at_time), rate)]

    return keyed(stream, "node_id", ["at_time"], (0, 0, False), "total long, at_time long, seen boolean", "node_id long, at_time long, rate double", step)


def outages(stream: DataFrame, silence: int = OFFLINE) -> DataFrame:
    """Silences of over 45 seconds (ST2), told when the node is heard again: ``node_id``, ``from_time``, ``to_time``."""

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        at = int(row.at_time)
        gap = state[0] >= 0 and at - state[0] > silence
        return (max(at, state[0]),), [(state[0], at)] if gap else []

    return keyed(stream, "node_id", ["at_time"], (-1,), "last long", "node_id long, from_time long, to_time long", step)


def presence(stream: DataFrame, silence: int = OFFLINE, delay: str = "10 seconds") -> DataFrame:
    """Nodes that fall silent and are heard again (ST2), told when it happens: ``node_id``, ``at_time``, ``event``.

    A node is ``offline`` once it has been silent for ``silence``, whether or not it is ever heard again.
    """

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        at = int(row.at_time)
        return (max(at, state[0]), False), [(at, "online")] if state[1] else []

    def due(state: tuple) -> int | None:
        return None if state[0] < 0 or state[1] else state[0] + silence

    def ring(state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return (state[0], True), [(at, "offline")]

    return timed(stream, "node_id", ["at_time"], (-1, False), "last long, told boolean", "node_id long, at_time long, event string", step, due, ring, delay)


def restarts(stream: DataFrame) -> DataFrame:
    """Restarts and duplicates of a node's agent (ST4): a later start is a restart, an earlier one a second agent.

    An earlier start is only taken for the node again once the later one has been silent for 90 seconds.
    """

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        started, seen = state
        at, own = int(row.at_time), int(row.started)
        if seen < 0 or own == started:
            return (own, at), []
        if own > started or at - seen > 90_000_000:
            return (own, at), [(at, "restart")]
        return state, [(at, "duplicate")]

    return keyed(stream, "node_id", ["at_time"], (-1, -1), "started long, seen long", "node_id long, at_time long, event string", step)


def notifications(stream: DataFrame) -> DataFrame:
    """What to tell of each finding (ST8): opened, worse, reminder, resolved.

    ``key``, ``at_time``, ``severity`` (null: not there at this look). A finding is told once it has
    lasted two minutes, a critical one and one that gets worse at once; it is resolved once it has been
    gone for five minutes, and told again every day.
    """

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        since, gone, sent, rank = state
        at = int(row.at_time)
        if isinstance(row.severity, str):
            new = RANKS[row.severity]
            if sent < 0:
                since = at if since < 0 else since
                if new == 2 or at - since >= OPEN_AFTER:
                    return (-1, -1, at, new), [(at, "opened", row.severity)]
                return (since, -1, -1, new), []
            if new > rank:
                return (-1, -1, at, new), [(at, "worse", row.severity)]
            if at - sent >= REMIND_AFTER:
                return (-1, -1, at, new), [(at, "reminder", row.severity)]
            return (-1, -1, sent, rank), []
        if sent < 0:
            return (-1, -1, -1, -1), []
        gone = at if gone < 0 else gone
        if at - gone >= RESOLVE_AFTER:
            return (-1, -1, -1, -1), [(at, "resolved", None)]
        return (-1, gone, sent, rank), []

    return keyed(stream, "key", ["at_time"], (-1, -1, -1, -1), "since long, gone long, sent long, rank long", "key long, at_time long, event string, severity string", step)


def reports(stream: DataFrame) -> DataFrame:
    """What becomes of agents' reports on operations (ST10): ``op``, ``at_time``, ``report``, ``verdict``, ``status``.

    Final outcomes stand: the same one again is accepted, another refused. An outcome overrides what
    the console gave up on (``expired`` after an attempt).
    """

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        status, attempts = state
        said, verdict = row.report, "accepted"
        if said == "leased":
            status, attempts = ("leased", attempts + 1) if status == "queued" else (status, attempts)
        elif status in TERMINAL and not (status == "expired" and attempts > 0):
            same = status == said or (status == "cancelled" and said == "failed")
            verdict = "accepted" if same else "refused"
        elif said == "running" and status == "queued" and attempts == 0:
            verdict = "refused"
        else:
            status = said
        return (status, attempts), [(int(row.at_time), said, verdict, status)]

    return keyed(stream, "op", ["at_time"], ("queued", 0), "status string, attempts long", "op long, at_time long, report string, verdict string, status string", step)


def sustained(stream: DataFrame, confirm: int = 30_000_000) -> DataFrame:
    """When all witnesses have called a primary lost for long enough (ST11): ``pair``, ``at_time`` of the confirmation.

    ``lost`` is null where a witness cannot tell, which breaks the run like a denial.
    """

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        since, told = state
        at = int(row.at_time)
        if row.lost is None or pd.isna(row.lost) or not row.lost:
            return (-1, False), []
        since = at if since < 0 else since
        if not told and at - since >= confirm:
            return (since, True), [(at,)]
        return (since, told), []

    return keyed(stream, "pair", ["at_time"], (-1, False), "since long, told boolean", "pair long, at_time long", step)


def confirmed(stream: DataFrame, confirm: int = 30_000_000, delay: str = "10 seconds") -> DataFrame:
    """``sustained``, told at the very time the confirmation falls due, not with the next row (ST11)."""

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        if row.lost is None or pd.isna(row.lost) or not row.lost:
            return (-1, False), []
        return (int(row.at_time) if state[0] < 0 else state[0], state[1]), []

    def due(state: tuple) -> int | None:
        return None if state[0] < 0 or state[1] else state[0] + confirm

    def ring(state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return (state[0], True), [(at,)]

    return timed(stream, "pair", ["at_time"], (-1, False), "since long, told boolean", "pair long, at_time long", step, due, ring, delay)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream over files gives now, written to the shared folder and read back."""
    spark: SparkSession = stream.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")

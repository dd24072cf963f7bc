"""Keyed machines with several timers a key, on ``transformWithState``: notifications with delivery, leases, fan-out.

A machine is plain: ``row`` takes a state and a row, ``due`` tells when which timer rings, ``ring`` what then
becomes of the state; each gives what is told. ``folded`` runs one over rows in the order of their times and
is what a stream must agree with, however it is cut into micro-batches: timers that fall due before a row
ring before it, and those of silent keys with the watermark. A machine that waits for an answer takes no rows
until it has it; ``Delivery`` asks for it within the micro-batch.
"""

from __future__ import annotations

import zlib
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import OPEN_AFTER, RANKS, REMIND_AFTER, RESOLVE_AFTER, TERMINAL, drained

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The pause after a failed delivery, a lease, deliveries of one piece of work, a subscriber's queue and the time between two frames.
PAUSE, LEASE, ATTEMPTS, QUEUE, FRAME = 300_000_000, 120_000_000, 5, 600, 250_000
NAMES = {v: k for k, v in RANKS.items()}
State = tuple
Told = list[tuple]


class Machine:
    """``start``: the state of a key that nothing is known of; a key that comes back to it is forgotten."""

    start: State
    state: str
    output: str

    def row(self, now: State, row: Any) -> tuple[State, Told]:
        raise NotImplementedError

    def due(self, now: State) -> list[tuple[int, str]]:
        """Times and names of the timers that are set; the earliest one rings first."""
        return []

    def ring(self, now: State, name: str, at: int) -> tuple[State, Told]:
        raise NotImplementedError

    def waits(self, now: State) -> bool:
        """Whether an answer is awaited; rows wait then, and timers do not ring."""
        return False

    def answer(self, now: State, row: Any) -> State:
        return now

    def order(self, row: Any) -> tuple:
        return (row.at_time,)


def ringing(machine: Machine, now: State, before: int) -> tuple[State, Told]:
    told: Told = []
    while not machine.waits(now) and (set_ := machine.due(now)) and min(set_)[0] < before:
        at, name = min(set_)
        now, more = machine.ring(now, name, at)
        told += more
    return now, told


def stepped(machine: Machine, now: State, rows: list, before: int) -> tuple[State, Told, list]:
    """The state after ``rows`` and all timers before a time; the rows that still wait are given back."""
    told: Told = []
    for k, row in enumerate(rows):
        now, more = ringing(machine, now, int(row.at_time))
        told += more
        if machine.waits(now):
            return now, told, rows[k:]
        now, more = machine.row(now, row)
        told += more
    now, more = ringing(machine, now, before)
    return now, told + more, []


def folded(machine: Machine, rows: Iterable, before: int, deliver: Callable[[tuple], Any] | None = None) -> Told:
    """All that one key's rows make a machine tell; ``deliver`` answers what is told at once."""
    now, out, rest = machine.start, [], sorted(rows, key=machine.order)
    while True:
        now, told, rest = stepped(machine, now, rest, before)
        out += told
        if not machine.waits(now):
            return out
        now = machine.answer(now, deliver(told[-1]))


class Keyed(StatefulProcessor):
    """A machine per key that waits for no answers: its state, and a Spark timer for each of its own."""

    def __init__(self, machine: Machine, columns: list[str]):
        self.machine, self.columns = machine, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", self.machine.state)

    def _go(self, key: tuple, rows: list, clock: int) -> Iterator[Row]:
        # A key without a state has no timers, so the store is not asked for them.
        known = self.now.get()
        now = self.machine.start if known is None else tuple(known)
        now, told, _ = stepped(self.machine, now, sorted(rows, key=self.machine.order), clock * 1000)
        set_timers(self.handle, {max(at // 1000, clock) + 1 for at, _ in self.machine.due(now)}, known is not None)
        if now != self.machine.start:
            if known is None or now != tuple(known):
                self.now.update(now)
        elif known is not None:
            self.now.clear()
        for x in told:
            yield Row(**dict(zip(self.columns, (*key, *x), strict=True)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._go(tuple(key), list(rows), max(timerValues.getCurrentWatermarkInMs(), 0))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._go(tuple(key), [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def set_timers(handle: StatefulProcessorHandle, timers: set[int], known: bool) -> None:
    """Leaves a key with these timers; one that is not known yet has none."""
    there = set(handle.listTimers()) if known else set()
    for old in there - timers:
        handle.deleteTimer(old)
    for new in timers - there:
        handle.registerTimer(new)


def on(stream: DataFrame, machine: Machine, keys: list[str], delay: str) -> DataFrame:
    """``machine`` over a stream: ``keys``, ``at_time`` and the other columns of its rows, and ``clock``, if that is another time."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = [*keys, *[c.strip().split(" ")[0] for c in machine.output.split(",")]]
    types = dict(stream.dtypes)
    output = ", ".join([*[f"{k} {types[k]}" for k in keys], machine.output])
    if "clock" not in stream.columns:
        stream = stream.withColumn("clock", F.timestamp_micros("at_time"))
    return stream.withWatermark("clock", delay).groupBy(*keys).transformWithState(Keyed(machine, columns), output, "append", "eventtime")


# notifications (ST8)


class Notices(Machine):
    """What one channel is told of one finding: opened, worse, reminder, resolved; each counts only once it is delivered.

    A finding opens once it has lasted two minutes (a critical one at once), is said again at once when it
    gets worse and every day while it is there, and is resolved once it has been gone for five minutes. One
    that is still there below the channel's least severity is neither repeated nor resolved. After a failed
    delivery nothing is tried for five minutes; then it is looked at anew.
    """

    state = "since long, gone long, sent long, rank long, current long, changed long, pause long, asked long, event string"
    output = "at_time long, event string, severity string"
    start = (-1, -1, -1, -1, -1, -1, -1, -1, "")

    def __init__(self, remind: int = REMIND_AFTER):
        self.remind = remind

    def order(self, row: Any) -> tuple:
        return row.at_time, RANKS.get(row.severity, -1)

    def row(self, now: State, row: Any) -> tuple[State, Told]:
        since, gone, sent, rank, current, changed, pause, asked, event = now
        at, new = int(row.at_time), RANKS.get(row.severity, -1)
        changed = at if new != current or changed < 0 else changed
        shown = new >= row.least and new >= 0
        if sent < 0:
            since, gone = (at if since < 0 else since) if shown else -1, -1
        else:
            gone = -1 if new >= 0 else at if gone < 0 else gone
        if sent < 0 and not shown:
            return self.start, []
        # What is below the least severity is there, but not for this channel: it is kept as -2.
        return (since, gone, sent, rank, new if shown else -1 if new < 0 else -2, changed, pause, asked, event), []

    def due(self, now: State) -> list[tuple[int, str]]:
        since, gone, sent, rank, current, changed, pause, _, _ = now
        if sent < 0:
            found = [(changed if current == 2 else since + OPEN_AFTER, "opened")] if since >= 0 else []
        elif current >= 0:
            found = [(changed, "worse")] if current > rank else [(max(sent + self.remind, changed), "reminder")]
        else:
            found = [(gone + RESOLVE_AFTER, "resolved")] if gone >= 0 else []
        return [(max(at, pause), name) for at, name in found]

    def ring(self, now: State, name: str, at: int) -> tuple[State, Told]:
        return (*now[:7], at, name), [(at, name, None if name == "resolved" else NAMES[now[4]])]

    def waits(self, now: State) -> bool:
        return now[7] >= 0

    def answer(self, now: State, row: Any) -> State:
        since, gone, sent, rank, current, changed, pause, asked, event = now
        if asked < 0 or int(row.at_time) != asked:  # an answer that has come before
            return now
        if not row.ok:
            return (since, gone, sent, rank, current, changed, asked + PAUSE, -1, "")
        if event == "resolved":
            return self.start
        return (-1, -1, asked, current, current, changed, -1, -1, "")


MESSAGES = "channel string, key long, at_time long, event string, severity string, delivered boolean"
Send = Callable[[str, pd.DataFrame], list[bool]]
#: Shares into which findings are dealt out, and lines that a channel gets at once.
SHARES, LINES = 1024, 10_000
Look = namedtuple("Look", "at_time severity least")
Answer = namedtuple("Answer", "at_time ok")


class Delivery(StatefulProcessor):
    """``Notices`` of the findings of one share, for each channel: their states in one record, a Spark timer for the earliest of theirs.

    A finding that waits for its channel's answer has it at once: what all findings of the share ask is
    sent together, and they go on with their answers until none asks. So states only move on delivery,
    and no row waits for a later micro-batch.
    """

    def __init__(self, machine: Notices, channels: list[tuple[str, int]], send: Send):
        self.machine, self.channels, self.send = machine, channels, send

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "states binary")

    def _states(self) -> dict[tuple[int, int | None], State]:
        """By channel and key; nothing is asked between micro-batches, so the last two fields are not kept."""
        known = self.held.get()
        rows = [] if known is None else np.frombuffer(zlib.decompress(known[0]), np.int64).reshape(-1, 10).tolist()
        return {(c, None if nil else key): (*now, -1, "") for c, nil, key, *now in rows}

    def _keep(self, states: dict[tuple[int, int | None], State], clock: int, known: bool) -> None:
        due = min((at for now in states.values() for at, _ in self.machine.due(now)), default=None)
        set_timers(self.handle, set() if due is None else {max(due // 1000, clock) + 1}, known)
        if states:
            rows = [(c, key is None, key or 0, *now[:7]) for (c, key), now in states.items()]
            self.held.update((zlib.compress(np.array(rows, np.int64).tobytes(), 1),))
        elif known:
            self.held.clear()

    def _go(self, looks: dict[int | None, list[tuple]], clock: int) -> Iterator[pd.DataFrame]:
        machine, states = self.machine, self._states()
        known = bool(states)
        going = [(c, key, states.pop((c, key), machine.start), [Look(*x, least) for x in own]) for key, own in looks.items() for c, (_, least) in enumerate(self.channels)]
        going += [(*k, now, []) for k, now in states.items()]
        states = {}
        while going:
            asked: list[list[tuple]] = [[] for _ in self.channels]
            for c, key, now, rest in going:
                now, told, rest = stepped(machine, now, rest, clock * 1000)
                if machine.waits(now):
                    asked[c].append((key, now, rest, told[-1]))
                elif now != machine.start:
                    states[c, key] = now
            going = []
            for c, (channel, _) in enumerate(self.channels):
                for k in range(0, len(asked[c]), LINES):
                    own = asked[c][k : k + LINES]
                    lines = pd.DataFrame([(channel, key, *told) for key, _, _, told in own], columns=["channel", "key", "at_time", "event", "severity"])
                    done = [bool(x) for x in self.send(channel, lines)]
                    yield lines.assign(delivered=done)
                    going += [(c, key, machine.answer(now, Answer(told[0], ok)), rest) for (key, now, rest, told), ok in zip(own, done, strict=True)]
        self._keep(states, clock, known)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.assign(rank=frame["severity"].map(RANKS).fillna(-1)).sort_values(["at_time", "rank"], kind="stable")
        looks: dict[int | None, list[tuple]] = {}
        for nil, key_, at, severity in zip(*(frame[c].tolist() for c in ("nil", "key", "at_time", "severity")), strict=True):
            looks.setdefault(None if nil else key_, []).append((at, severity))
        yield from self._go(looks, max(timerValues.getCurrentWatermarkInMs(), 0))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._go({}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def delivered(looks: DataFrame, channels: DataFrame, send: Send, delay: str = "10 seconds", remind: int = REMIND_AFTER, shares: int = SHARES) -> DataFrame:
    """Notifications of a stream of looks, sent and answered, until nothing more is to be sent: ``MESSAGES``.

    ``looks(key, at_time, severity)``, a null severity means not there; ``channels(channel, least)`` are a
    handful and at most ten. Findings are dealt out into ``shares`` by their keys. ``send(channel, lines)``
    runs in tasks, for up to ``LINES`` of one channel's lines, and says which of them were delivered; only
    that moves the state. A crash between sending and the end of a micro-batch sends its lines again.
    """
    looks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    known = [(r.channel, RANKS[r.least]) for r in channels.limit(10).collect()]
    dealt = looks.select(F.pmod(F.xxhash64("key"), F.lit(shares)).alias("share"), F.col("key").isNull().alias("nil"), F.coalesce("key", F.lit(0)).alias("key"), "at_time", "severity", F.timestamp_micros("at_time").alias("clock"))
    told = dealt.withWatermark("clock", delay).groupBy("share").transformWithStateInPandas(Delivery(Notices(remind), known, send), MESSAGES, "append", "eventtime")
    return drained(told, "notices")


# leases (ST9)


class Leases(Machine):
    """One piece of work from submission to its end, with leases that lapse and work that is never started.

    ``kind`` of a row: ``submit`` (with ``ttl`` in microseconds), ``poll`` (its agent asks for work) or what
    the agent reports: ``running``, ``succeeded``, ``failed``. A lease lasts two minutes and longer with
    each sign of life; work whose lease lapses is queued again, and fails after five deliveries. Queued
    work expires once it has waited for longer than its ``ttl`` since it was submitted or handed back.
    What the console gave up on takes the agent's word after all.
    """

    state = "status string, attempts long, since long, until long, ttl long, gave_up boolean"
    output = "at_time long, event string, status string, attempts long"
    start = ("", 0, -1, -1, 0, False)
    KINDS = ["submit", "poll", "running", "succeeded", "failed"]

    def order(self, row: Any) -> tuple:
        return row.at_time, self.KINDS.index(row.kind)

    def row(self, now: State, row: Any) -> tuple[State, Told]:
        status, attempts, since, until, ttl, gave_up = now
        at, kind = int(row.at_time), row.kind
        tell = lambda state, event: (state, [(at, event, state[0], state[1])])
        if kind == "submit":
            return tell(("queued", 0, at, -1, int(row.ttl), False), "queued") if not status else (now, [])
        if not status:
            return now, []
        if kind == "poll":
            return tell(("leased", attempts + 1, at, at + LEASE, ttl, False), "leased") if status == "queued" else (now, [])
        if status in TERMINAL and not gave_up:
            return tell(now, "repeated" if status == kind else "refused")
        if kind == "running":
            if status == "queued" and attempts == 0:
                return tell(now, "refused")
            adopted = gave_up or status == "queued"
            new = ("running", attempts, at if status != "running" else since, at + LEASE, ttl, False)
            return tell(new, "adopted" if adopted else "running") if status != "running" else (new, [])
        return tell((kind, attempts, at, -1, ttl, False), kind)

    def due(self, now: State) -> list[tuple[int, str]]:
        status, _, since, until, ttl, _ = now
        return [(since + ttl, "ttl")] if status == "queued" else [(until, "lease")] if status in ("leased", "running") else []

    def ring(self, now: State, name: str, at: int) -> tuple[State, Told]:
        status, attempts, _, _, ttl, _ = now
        if name == "ttl":
            new, event = ("expired", attempts, at, -1, ttl, attempts > 0), "expired"
        elif attempts >= ATTEMPTS:
            new, event = ("failed", attempts, at, -1, ttl, True), "given up"
        else:
            new, event = ("queued", attempts, at, -1, ttl, False), "redelivered"
        return new, [(at, event, new[0], attempts)]


def leases(stream: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``op``, ``at_time``, ``event``, ``status``, ``attempts`` of each change of work (ST9); ``stream(op, at_time, kind, ttl)``."""
    return on(stream, Leases(), ["op"], delay)


# fan-out (ST6)


class Frames(Machine):
    """A subscriber's queue: at each tick a frame with the newest ``most`` entries since the last one, and how many older ones were dropped.

    A row with an ``entry`` joins the queue, and so do the ``entries`` of one tick with their ``times`` of a row
    that has several, with how many older ones were ``dropped`` beside them; one with ``busy_until`` (a subscriber
    that is backed up) makes all ticks before that time pass without a frame. The queue never holds more than
    ``most`` entries.
    """

    state = "queue array<long>, times array<long>, dropped long, first long, busy long"
    output = "at_time long, entries array<long>, dropped long"
    start = ([], [], 0, -1, -1)

    def __init__(self, most: int = QUEUE, period: int = FRAME):
        self.most, self.period = most, period

    def order(self, row: Any) -> tuple:
        return row.at_time, row.busy_until is None, row.entry or 0

    def row(self, now: State, row: Any) -> tuple[State, Told]:
        queue, times, dropped, first, busy = now
        if row.busy_until is not None:
            return (queue, times, dropped, first, max(busy, int(row.busy_until))), []
        several = getattr(row, "entries", None)
        more = [(int(row.at_time), row.entry)] if several is None else list(zip(row.times, several, strict=True))
        both = sorted([*zip(times, queue, strict=True), *more])
        cut = max(0, len(both) - self.most)
        dropped += cut + (0 if several is None else int(row.dropped))
        return ([e for _, e in both[cut:]], [t for t, _ in both[cut:]], dropped, int(row.at_time) if first < 0 else first, busy), []

    def due(self, now: State) -> list[tuple[int, str]]:
        _, _, _, first, busy = now
        ready = [(max(-(-busy // self.period), first // self.period + 1) * self.period - 1, "frame")] if first >= 0 else []
        return ready or ([(busy - 1, "free")] if busy >= 0 else [])

    def ring(self, now: State, name: str, at: int) -> tuple[State, Told]:
        queue, _, dropped, _, _ = now
        return self.start, [(at + 1, list(queue), dropped)] if name == "frame" else []


#: Rows that a task holds while it brings those of one tick together.
HELD = 200_000
PARTS = "subscriber {kind}, at_time long, clock timestamp, busy_until long, entries array<long>, times array<long>, dropped long"


def ticked(rows: DataFrame, most: int, period: int) -> DataFrame:
    """``rows(subscriber, at_time, entry)`` brought together by subscriber and tick within each task: ``PARTS``.

    Only the newest ``most`` entries of a tick can be in its frame, the others count. ``at_time`` is the first
    entry's and ``clock`` the last one's, so that the watermark is that of the entries.
    """

    def folded_(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["subscriber", "tick", "at_time", "entry"], kind="stable")
        by = held.groupby(["subscriber", "tick"], sort=False)
        first, back = by["first"].transform("min"), by.cumcount(ascending=False)
        sums = by["dropped"].transform("sum") + (by["entry"].transform("size") - most).clip(lower=0)
        last = back == 0
        held = held.assign(first=first, dropped=sums.where(last, 0))
        return held[back < most]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(held: pd.DataFrame) -> pd.DataFrame:
            by = held.groupby(["subscriber", "tick"], sort=False)
            out = by.agg(at_time=("first", "min"), clock=("at_time", "max"), entries=("entry", list), times=("at_time", list), dropped=("dropped", "sum")).reset_index()
            return out.assign(clock=pd.to_datetime(out["clock"], unit="us", utc=True), busy_until=pd.array([None] * len(out), dtype="Int64"))[["subscriber", "at_time", "clock", "busy_until", "entries", "times", "dropped"]]

        parts, n = [], 0
        for frame in frames:
            parts.append(frame.assign(tick=frame["at_time"] // period, first=frame["at_time"], dropped=0))
            n += len(frame)
            if n >= HELD:
                held = folded_(pd.concat(parts, ignore_index=True))
                if len(held) > HELD // 2:  # ticks with few entries each: nothing is gained by holding them longer
                    yield told(held)
                    held = held[:0]
                parts, n = [held], len(held)
        if n:
            yield told(folded_(pd.concat(parts, ignore_index=True)))

    return rows.select("subscriber", "at_time", "entry").mapInPandas(run, PARTS.format(kind=dict(rows.dtypes)["subscriber"]))


def frames(entries: DataFrame, subscriptions: DataFrame, most: int = QUEUE, period: int = FRAME, busy: DataFrame | None = None, delay: str = "10 seconds") -> DataFrame:
    """``subscriber``, ``at_time``, ``entries``, ``dropped`` of each frame (ST6).

    ``entries(entry, at_time, cluster_id, rank)`` is a stream; ``subscriptions(subscriber, cluster_id, least)``
    a table, whose null cluster stands for all; ``busy(subscriber, at_time, busy_until)`` a stream. Tasks bring
    the entries of a tick together before a subscriber gets them; such a part is late if its newest entry is.
    """
    scopes = entries.withColumn("scope", F.explode(F.array(F.col("cluster_id").cast("string"), F.lit("all"))))
    wanted = subscriptions.select("subscriber", F.coalesce(F.col("cluster_id").cast("string"), F.lit("all")).alias("scope"), "least")
    rows = scopes.join(wanted, "scope").filter("rank >= least")
    rows = ticked(rows, most, period).withColumn("entry", F.lit(None).cast("long"))
    if busy is not None:
        rows = rows.unionByName(busy.select("subscriber", "at_time", F.timestamp_micros("at_time").alias("clock"), "busy_until"), allowMissingColumns=True)
    return on(rows, Frames(most, period), ["subscriber"], delay)


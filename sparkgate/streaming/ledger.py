"""A spending ledger as a stream: reservations are held per run until they are settled, fail, expire or the run is cancelled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "run long, seq long, attempt long, outcome string, charge long, available long"
TOTALS = ["reserved", "charged", "estimated", "actual", "attempts", "unknown", "failed", "failed_charge", "cancelled"]
TOTALS_SCHEMA = ", ".join(f"{c} long" for c in TOTALS)
OPEN_SCHEMA = "amount long, deadline long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def failed_cost(status: int | None) -> int | None:
    """What a failed attempt costs: nothing for a received status that says it was refused before it ran, else unknown."""
    return 0 if status is not None and not 200 <= status < 300 and status != 408 and status < 500 else None


@dataclass
class Ledger:
    """The ledger of one run: totals in whole parts of a unit, and the open reservations by attempt as (amount, deadline)."""

    budget: int
    totals: dict[str, int] = field(default_factory=lambda: dict.fromkeys(TOTALS, 0))
    open: dict[int, tuple[int, int]] = field(default_factory=dict)
    #: (deadline, attempt) of every open reservation, as a heap; entries of closed ones stay until they come up.
    due: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.due = [(deadline, attempt) for attempt, (_, deadline) in self.open.items()]
        heapify(self.due)

    def available(self) -> int:
        return max(0, self.budget - self.totals["charged"] - self.totals["reserved"])

    def _close(self, attempt: int, cost: int | None, failed: bool) -> int:
        amount, _ = self.open.pop(attempt)
        t, charge = self.totals, amount if cost is None else cost
        t["reserved"] -= amount
        t["charged"] += charge
        t["attempts"] += 1
        if failed:
            t["failed"] += 1
            t["failed_charge"] += charge
        else:
            t["estimated"] += amount
            t["actual"] += cost or 0
            t["unknown"] += cost is None
        return charge

    def expire(self, now: int) -> Iterator[tuple[int, str, int]]:
        """Reservations whose deadline has come settle as unknown: they stay charged. Earliest first, then by attempt."""
        while self.due and self.due[0][0] <= now:
            deadline, attempt = heappop(self.due)
            if attempt in self.open and self.open[attempt][1] == deadline:
                yield attempt, "expired", self._close(attempt, None, False)

    def apply(self, kind: str, attempt: int | None, amount: int | None, status: int | None, deadline: int) -> tuple[str, int]:
        """(outcome, charge) of one event."""
        if kind == "cancel":
            self.totals["cancelled"] = 1
            return "cancelled", 0
        if kind == "reserve":
            if amount is None or amount < 0 or attempt is None or attempt in self.open:
                return "invalid", 0
            if self.totals["cancelled"]:
                return "refused_cancelled", 0
            if self.totals["charged"] + self.totals["reserved"] >= self.budget or amount > self.available():
                return "refused_budget", 0
            self.open[attempt] = (amount, deadline)
            heappush(self.due, (deadline, attempt))
            self.totals["reserved"] += amount
            return "reserved", 0
        if attempt not in self.open:
            return "unknown_attempt", 0
        cost = amount if amount is not None and amount >= 0 else None
        if kind == "settle":
            return "settled", self._close(attempt, cost, False)
        if kind == "fail":
            return "failed", self._close(attempt, failed_cost(status) if cost is None else cost, True)
        return ("released", self._close(attempt, None, False)) if kind == "release" else ("invalid", 0)


def _whole(values: list) -> list[int | None]:
    return [None if x is None or x != x else int(x) for x in values]


def _nullable(values: list[int | None]) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.array([x or 0 for x in values], "int64"), np.array([x is None for x in values]))


def _earliest(held: dict[int, tuple[int, int]]) -> int | None:
    return min((deadline for _, deadline in held.values()), default=None)


class LedgerProcessor(StatefulProcessor):
    """Totals are a value, open reservations a map: a batch writes only those that it opened or closed. A timer ends what no event ends: a run has one, at the earliest deadline of its open reservations."""

    def __init__(self, budget: int, timeout: int):
        self.budget, self.timeout = budget, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS_SCHEMA)
        self.open = handle.getMapState("open", "attempt long", OPEN_SCHEMA)

    def _load(self) -> Ledger:
        held = self.totals.get()
        if held is None:
            return Ledger(self.budget)
        return Ledger(self.budget, dict(zip(TOTALS, held)), {k[0]: tuple(v) for k, v in self.open.iterator()})

    def _save(self, before: dict, ledger: Ledger, fired: int | None = None) -> None:
        """fired: the run's timer, if it brought us here; it is gone by itself."""
        self.totals.update(tuple(ledger.totals[c] for c in TOTALS))
        for attempt in before.keys() - ledger.open.keys():
            self.open.removeKey((attempt,))
        for attempt, held in ledger.open.items():
            if before.get(attempt) != held:
                self.open.updateValue((attempt,), held)
        was, now = _earliest(before), _earliest(ledger.open)
        if was != now:
            if was is not None and was != fired:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)

    def _rows(self, run, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            seq, attempt, outcome, charge, available = map(list, zip(*rows))
            yield pd.DataFrame({"run": run, "seq": _nullable(seq), "attempt": _nullable(attempt), "outcome": outcome, "charge": charge, "available": available})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ledger = self._load()
        before, out = dict(ledger.open), []
        # Plain lists: a run has few events in a batch, and each pandas call costs more than all of them.
        columns = {c: [] for c in ("seq", "at", "kind", "attempt", "amount", "status")}
        for part in rows:
            if part["at"].hasnans:
                raise ValueError("an event without a time")
            columns["at"] += part["at"].to_numpy("datetime64[ms]").astype("int64").tolist()
            for c in ("seq", "kind", "attempt", "amount", "status"):
                columns[c] += part[c].tolist()
        for c in ("attempt", "amount", "status"):
            columns[c] = _whole(columns[c])
        for seq, now, kind, attempt, amount, status in sorted(zip(*columns.values()), key=lambda e: e[0]):
            out += [(None, closed, outcome, charge, ledger.available()) for closed, outcome, charge in ledger.expire(now)]
            outcome, charge = ledger.apply(kind, attempt, amount, status, now + self.timeout)
            out.append((int(seq), attempt, outcome, charge, ledger.available()))
        self._save(before, ledger)
        yield from self._rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed settles at once."""
        ledger, fired = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        before = dict(ledger.open)
        out = [(None, attempt, outcome, charge, ledger.available()) for attempt, outcome, charge in ledger.expire(max(fired, timerValues.getCurrentWatermarkInMs()))]
        self._save(before, ledger, fired)
        yield from self._rows(key[0], out)

    def close(self) -> None:
        pass


def ledger(events: DataFrame, budget: int, timeout_ms: int, late: str = "0 seconds") -> DataFrame:
    """A stream of events (run, seq, at, kind, attempt, amount, status) with what became of each: run, seq, attempt, outcome, charge, available.

    reserve holds an amount, or is refused when it doesn't fit in what is left of the run's budget, when nothing is left, when the run is cancelled, or when the amount is no amount (invalid, as is a second reservation of an open attempt). settle
    charges the reported amount, or the reservation where none is reported; fail charges a refused attempt nothing (see failed_cost); release charges the reservation; cancel refuses all later reservations, while open ones still settle. Events of attempts that aren't
    open are unknown_attempt. A reservation that timeout_ms of event time pass over settles as unknown (outcome expired, no seq): before the next event of its run, or by a timer when the watermark passes.

    Events of a run count in order of seq within a micro-batch, and micro-batches in order of arrival, so that a stream in order gives the same in one batch or many. A run's part of one micro-batch and its open
    reservations are held in memory. The session must use the RocksDB state store (PROVIDER, ROCKS).
    """
    read = events.select("run", "seq", "at", "kind", "attempt", "amount", "status").withWatermark("at", late)
    return read.groupBy("run").transformWithStateInPandas(LedgerProcessor(budget, timeout_ms), OUTCOMES, "append", "EventTime")

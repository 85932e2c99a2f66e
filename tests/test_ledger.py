"""The ledger as a stream against the same rules kept in plain variables, in one micro-batch and in many."""

import datetime
import random

import pytest

from sparkgate.plans import further
from sparkgate.session import scratch_path
from sparkgate.streaming import flows
from sparkgate.streaming.ledger import PROVIDER, ROCKS, Ledger, failed_cost, ledger

EVENTS = "run long, seq long, at timestamp, kind string, attempt long, amount long, status int"
BUDGET, TIMEOUT = 100, 50_000


def drawn(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    at, out = 1_700_000_000_000, []
    for seq in range(n):
        at += rng.choice([0, 500, 1000, 20_000])
        kind = rng.choices(["reserve", "settle", "fail", "release", "cancel", "odd"], [9, 5, 3, 1, 0.15, 0.2])[0]
        amount = rng.choice([None, -1, 0, 1, 5, 20, 60]) if rng.random() < 0.5 else rng.randrange(12)
        out.append((rng.randrange(6), seq, at, kind, rng.choice([None, *range(12)]), amount, rng.choice([None, 200, 400, 404, 408, 429, 500])))
    return out


def plain(events: list[tuple], budget: int = BUDGET, timeout: int = TIMEOUT) -> list[tuple]:
    out, runs = [], {}

    def expire(run, now):
        r = runs[run]
        for deadline, attempt in sorted((d, a) for a, (_, d) in r["open"].items()):
            if deadline <= now:
                amount, _ = r["open"].pop(attempt)
                r["charged"] += amount
                out.append((run, None, attempt, "expired", amount, left(r)))

    def left(r):
        return max(0, budget - r["charged"] - sum(a for a, _ in r["open"].values()))

    for run, seq, at, kind, attempt, amount, status in events:
        r = runs.setdefault(run, {"open": {}, "charged": 0, "cancelled": False})
        expire(run, at)
        charge = 0
        held = r["open"].get(attempt)
        if kind == "cancel":
            r["cancelled"], outcome = True, "cancelled"
        elif kind == "reserve":
            if amount is None or amount < 0 or attempt is None or held:
                outcome = "invalid"
            elif r["cancelled"]:
                outcome = "refused_cancelled"
            elif left(r) == 0 or amount > left(r):
                outcome = "refused_budget"
            else:
                r["open"][attempt], outcome = (amount, at + timeout), "reserved"
        elif not held:
            outcome = "unknown_attempt"
        elif kind in ("settle", "fail", "release"):
            del r["open"][attempt]
            reported = amount if amount is not None and amount >= 0 else None
            free = status is not None and not 200 <= status < 300 and status != 408 and status < 500
            charge = held[0] if kind == "release" else reported if reported is not None else 0 if kind == "fail" and free else held[0]
            outcome = {"settle": "settled", "fail": "failed", "release": "released"}[kind]
            r["charged"] += charge
        else:
            outcome = "invalid"
        out.append((run, seq, attempt, outcome, charge, left(r)))
    for run in runs:
        expire(run, max(e[2] for e in events))
    return out


@pytest.fixture
def rocks(spark):
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield spark
    spark.conf.set(PROVIDER, was)


@pytest.mark.parametrize("files", [1, 5])
def test_ledger_in_one_batch_or_many(rocks, files):
    events = drawn(3, 300)
    want = plain(events)
    rows = [(r, s, datetime.datetime.fromtimestamp(t / 1000, datetime.timezone.utc), *rest) for r, s, t, *rest in events]
    frame = rocks.createDataFrame(rows, EVENTS)
    path = scratch_path(rocks, "ledger")
    step = -(-len(rows) // files)
    for k in range(files):
        frame.where(f"seq >= {k * step} and seq < {(k + 1) * step}").coalesce(1).write.mode("append").parquet(path)
    stream = rocks.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = [tuple(r) for r in flows.drained(ledger(stream, BUDGET, TIMEOUT), rocks, "ledger").collect()]
    key = lambda rows: sorted(rows, key=str)
    assert key(got) == key(want)
    assert {o for *_, o, _, _ in want} == {"reserved", "settled", "failed", "released", "expired", "refused_budget", "refused_cancelled", "invalid", "unknown_attempt", "cancelled"}


def test_failed_costs():
    assert [failed_cost(s) for s in (None, 200, 299, 301, 400, 407, 408, 409, 499, 500)] == [None, None, None, 0, 0, 0, None, 0, 0, None]


def test_the_query_like_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.run, r.seq, int(r.at.timestamp() * 1000), r.kind, r.attempt, r.amount, r.status) for r in further.spending(spark, sf).orderBy("seq").collect()]
    got = [tuple(r) for r in further.x03(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, 100_000, 600_000), key=str) and len({r[3] for r in got}) >= 8


def test_an_event_looks_at_due_reservations_only():
    """Thousands of open reservations cost an event nothing: only deadlines that have come are looked at."""

    class Watched(dict):
        def items(self):
            raise AssertionError("all open reservations are read")

    held = Ledger(10**9, open={a: (1, 1000 + a) for a in range(5000)})
    held.totals["reserved"] = 5000
    held.open = Watched(held.open)
    assert [a for a, *_ in held.expire(1002)] == [0, 1, 2]
    assert held.apply("settle", 3, 1, None, 0) == ("settled", 1) and held.apply("reserve", 3, 1, None, 1003) == ("reserved", 0)
    assert [a for a, *_ in held.expire(1004)] == [3, 4] and held.totals["reserved"] == 5000 - 5


def test_a_run_has_one_timer():
    """Thousands of open reservations take one timer, at the earliest deadline; when it fires, all that is due settles at once and the next one is set."""
    import pandas as pd

    from sparkgate.streaming.ledger import LedgerProcessor

    class Held(dict):
        def iterator(self):
            return iter(self.items())

        updateValue, removeKey = dict.__setitem__, dict.pop

    class Value:
        held = None
        get = lambda self: self.held
        update = lambda self, held: setattr(self, "held", held)

    class Handle:
        timers: set = set()
        getValueState = lambda self, *_: Value()
        getMapState = lambda self, *_: Held()
        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.remove(at)

    class Now:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    handle, processor = Handle(), LedgerProcessor(10**9, 1000)
    processor.init(handle)
    events = lambda seqs, kind: pd.DataFrame({"seq": seqs, "at": pd.to_datetime(seqs, unit="ms"), "kind": kind, "attempt": [s % 2000 for s in seqs], "amount": 1, "status": None})
    assert len(pd.concat(processor.handleInputRows((1,), [events(list(range(500)), "reserve")], None))) == 500
    assert handle.timers == {1000}
    list(processor.handleInputRows((1,), [events([500], "reserve").assign(attempt=0), events([501, 502], "settle").assign(attempt=[0, 1])], None))
    assert handle.timers == {1002}
    handle.timers.clear()  # a timer that fires is gone
    out = pd.concat(processor.handleExpiredTimer((1,), Now(1100), Now(1002)))
    assert out["attempt"].tolist() == list(range(2, 101)) and set(out["outcome"]) == {"expired"} and handle.timers == {1101}

"""Budget admission against a plain fold."""

import random

import pytest
from pyspark.sql.streaming import DataStreamWriter

from sparkgate.operators import judge
from sparkgate.plans.registry import QUERIES
from sparkgate.streaming import flows

SF = "/root/testdata/sf0.01"


def folded(rows, budget):
    spent, out = {}, []
    for run, seq, amount in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or 0)):
        good = amount is not None and amount >= 0 and spent.get(run, 0) + amount <= budget
        spent[run] = spent.get(run, 0) + (amount if good else 0)
        out.append((run, seq, good))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [0, 1, 1000])
def test_admit(spark, budget):
    rng = random.Random(budget)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(500), rng.choice([None, -5, 0, 1, 2, rng.randrange(40), rng.randrange(1100)])) for _ in range(1500)]
    # Each refusal leaves room for less than the next attempt asks.
    rows += [(7, k, 1 if k % 2 else 1000 - k // 2) for k in range(900)]
    got = judge.admit(spark.createDataFrame(rows, "run long, seq long, amount long").repartition(3), budget)
    assert sorted((tuple(r) for r in got.collect()), key=str) == folded(rows, budget)


def test_admit_of_nothing(spark):
    assert judge.admit(spark.createDataFrame([], "run long, seq long, amount long"), 5).count() == 0


@pytest.mark.parametrize("name", ["j06_budget_admission", "x01_stream_admission"])
def test_all_events_are_judged(spark, name):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id % 10", "event_id", "cast(round(value * 100) as long)")
    got = [tuple(r) for r in QUERIES[name](spark, SF).select("run", "event_id", "admitted").collect()]
    assert sorted(got, key=str) == folded([tuple(r) for r in events.collect()], 100_000)


def test_stream_in_several_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2]), seq, rng.choice([None, -5, 0, rng.randrange(40), rng.randrange(1100)])) for seq in range(900)]
    rng.shuffle(rows)
    stream = flows.in_order(spark.createDataFrame(rows, "run long, seq long, amount long").repartition(5), spark, "tries", "seq", most=200)
    judged = flows.admitted(stream, 3000).writeStream.format("memory").queryName("judged").outputMode("append").trigger(availableNow=True).start()
    judged.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in judged.recentProgress) == 5 and max(p["numInputRows"] for p in judged.recentProgress) < 300
    assert sorted((tuple(r) for r in spark.table("judged").collect()), key=str) == folded(rows, 3000)


def test_streams_are_few_batches_and_state_stores(spark, monkeypatch):
    """One micro-batch per million rows, and no more state stores than cores, whatever the session's number of shuffle partitions."""
    seen, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    start = DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: seen.append(start(self, *a, **k)) or seen[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        rows = spark.range(50_000).selectExpr("id % 10 AS run", "id AS seq", "id % 7 AS amount")
        assert flows.drained(flows.admitted(flows.in_order(rows, spark, "tries", "seq"), 1000), spark, "admitted").count() == 50_000
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    progress = [p for p in seen[0].recentProgress if p["numInputRows"]]
    assert len(progress) == 1 and progress[0]["stateOperators"][0]["numShufflePartitions"] <= spark.sparkContext.defaultParallelism

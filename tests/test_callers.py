"""Calls against wrappers, with repeated ids and with far more pairs than rows."""

import random

from sparkgate.operators import runs

CALLS = "call long, file int, python boolean, name string, object string, byte long, schema_keyword boolean"
WRAPPERS = "wrapper long, file int, start long, end long, python boolean, name string, method boolean"
BOUND, SPACES, MODULES = "call long, target int, start long", "file int, local string, target int", "target int, name string, start long"


def test_callers_of_repeated_ids_by_brute_force(spark):
    rng = random.Random(5)
    flag, name, file = lambda: rng.random() < 0.5, lambda: rng.choice(["run", "grade", "pick"]), lambda: rng.randrange(3)
    calls = [(k if k < 60 else rng.randrange(70), file(), flag(), name(), rng.choice([None, "m", "client"]), rng.randrange(20), flag()) for k in range(120)] * 2
    wrappers = [(k if k < 30 else rng.randrange(35), file(), s := rng.randrange(8), s + 6, flag(), name(), flag()) for k in range(60)] * 2
    bound = [(rng.randrange(70), file(), rng.randrange(8)) for _ in range(200)] * 2
    spaces, modules = [(file(), "m", file()) for _ in range(3)] * 2, [(file(), name(), rng.randrange(8)) for _ in range(30)] * 2
    want = set()
    for call, at, python, called, obj, byte, keyword in calls:
        for wrapper, w_file, start, end, w_python, w_name, method in wrappers:
            if python != w_python or (at == w_file and start <= byte < end):
                continue
            if obj is None and not method and (call, w_file, start) in bound:
                want.add((call, wrapper, "plain"))
            targets = [t for f, local, t in spaces if (f, local) == (at, obj)]
            if not method and w_file in targets and (w_file, called, start) in modules:
                want.add((call, wrapper, "namespace"))
            if obj is not None and not targets and method and called == w_name and (called not in runs.GENERIC_METHODS or keyword):
                want.add((call, wrapper, "method"))
    got = runs.callers(*[spark.createDataFrame(r, s).repartition(3) for r, s in ((calls, CALLS), (bound, BOUND), (spaces, SPACES), (modules, MODULES), (wrappers, WRAPPERS))]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and {h for *_, h in want} == {"plain", "namespace", "method"}


def test_pairs_are_not_shuffled(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    calls = spark.range(4000).selectExpr("id AS call", "0 AS file", "true AS python", "'grade' AS name", "'client' AS object", "0L AS byte", "true AS schema_keyword")
    wrappers = spark.range(200).selectExpr("id AS wrapper", "1 AS file", "0L AS start", "9L AS end", "true AS python", "'grade' AS name", "true AS method")
    none = [spark.createDataFrame([], s) for s in (BOUND, SPACES, MODULES)]
    before = written()
    assert runs.callers(calls, *none, wrappers).count() == 800_000
    assert written() - before < 1_000_000


def test_calls_are_sent_to_bindings_and_wrappers_only(spark):
    """Neither repeated ids nor a few modules have all calls sent anew, nor are calls sent once per kind of row that repeats."""
    calls = spark.range(4000).selectExpr("id AS call", "0 AS file", "true AS python", "'grade' AS name", "if(id % 2 = 0, 'm', null) AS object", "0L AS byte", "true AS schema_keyword")
    wrappers = spark.range(200).selectExpr("id AS wrapper", "1 AS file", "id % 5 AS start", "9L AS end", "true AS python", "'grade' AS name", "id % 3 = 0 AS method")
    bound = spark.range(4000).selectExpr("id AS call", "1 AS target", "id % 5 AS start")
    spaces, modules = spark.createDataFrame([(0, "m", 1)], SPACES), spark.createDataFrame([(1, "grade", 2)], MODULES)
    found = runs.callers(calls, bound, spaces, modules, wrappers)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 6
    assert {r.how: r["count"] for r in found.groupBy("how").count().collect()} == {"plain": 2000 * 133 // 5, "namespace": 2000 * 27}

"""Site records, scopes and digests against plain versions."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from sparkgate.functions import text as T
from sparkgate.operators import export, rank, runs, sites, validation
from sparkgate.plans import exports
from sparkgate.plans.registry import QUERIES, SQL


def test_free_ids_by_brute_force(spark):
    rng = random.Random(9)
    used = {rng.choice("abc") + rng.choice(["", "-2", "-3", "-5"]) for _ in range(9)}
    rows = [(k, rng.choice("abcd")) for k in range(60)]
    taken, want = set(used), {}
    for k, base in rows:
        n = 1
        while (base if n == 1 else f"{base}-{n}") in taken:
            n += 1
        want[k] = base if n == 1 else f"{base}-{n}"
        taken.add(want[k])
    got = sites.free_ids(spark.createDataFrame(rows, "k int, id string"), spark.createDataFrame([(u,) for u in used], "id string"), ["k"])
    assert {r.k: r.unique_id for r in got.collect()} == want


def test_snippet_by_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join("x" * rng.randrange(0, 700) for _ in range(n)) + rng.choice(["", "\n", "\r\n"]) for n in (0, 1, 5, 60, 200, 300) for _ in range(4)] + ["", "é😀\r\nb"]
    rows = [(k, t, rng.randrange(0, 320)) for k, t in enumerate(texts)]

    def plain(text, line):
        def lines(t):
            out = [x.removesuffix("\r") for x in t.split("\n")]
            return out[:-1] if t.split("\n")[-1] == "" else out

        first = max(line - 41, 0)
        window, out = "\n".join(lines(text)[first : first + 81]), ""
        for i, x in enumerate(lines(window)):
            one = f"{i + first + 1:>5} {x}\n"
            if len((out + one).encode()) > 16_384:
                break
            out += one
        return out

    got = spark.createDataFrame(rows, "k int, text string, line int").select("k", sites.snippet(F.col("text"), F.col("line")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: plain(t, n) for k, t, n in rows}


def test_tree_digest(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for n in (0, 1, 3, 4, 20):
        level = [sha(f"t{k}") for k in range(n)]
        while len(level) > 1:
            level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
        (r,) = export.tree_digest(spark.createDataFrame([(k + 1, f"t{k}") for k in range(n)], "at long, text string").repartition(3), "at", "text", width=3).collect()
        assert (r.n, r.sha256) == (n, level[0] if level else sha(""))


def test_names_bind_to_the_innermost_range(spark):
    rng = random.Random(4)
    defs = [(rng.randrange(2), rng.choice("xy"), s := rng.randrange(50), s + rng.randrange(1, 40), k) for k in range(60)]
    used = [(k, rng.randrange(3), rng.choice("xyz"), rng.randrange(100)) for k in range(200)]
    imports = [(0, "x", 900), (0, "x", 800), (2, "z", 700)]
    want = {}
    for k, file, name, byte in used:
        held = [d for d in defs if d[0] == file and d[1] == name and d[2] <= byte < d[3]]
        outer = [i[2] for i in imports if i[:2] == (file, name)]
        want[k] = (max(held, key=lambda d: (d[2], -d[3], d[4]))[4], "scope") if held else (min(outer), "import") if outer else (None, None)
    got = runs.bound_names(spark.createDataFrame(used, "k int, file int, name string, byte long"), spark.createDataFrame(defs, "file int, name string, start long, end long, def long"), spark.createDataFrame(imports, "file int, name string, def long"), ["k"])
    assert {r.k: (r["def"], r.how) for r in got.collect()} == want


def test_rules_on_hard_values(spark):
    rows = [("1.0", "a" * 128, "source:x", [1.0]), ("1.00", "a" * 129, "source: x", [1.0, 2.0, 2.0]), ("2.1", "-a", "source: ", [3.0, 2.0]), (None, None, "agent:" + "y" * 251, []), ("1.10", "a.b_c-d", "hook:x", [1.0, 3.0, 2.0])]
    df = spark.createDataFrame(rows, "v string, id string, site string, x array<double>")
    got = df.select(validation.version_state(F.col("v")).alias("v"), validation.is_registry_id(F.col("id")).alias("i"), validation.is_site_id(F.col("site")).alias("s"), validation.monotonic(F.col("x")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("ok", True, True, True), ("invalid", False, False, False), ("incompatible", False, False, True), ("invalid", None, False, True), ("ok", True, False, False)]


def test_labels_strip_unicode_space(spark):
    (r,) = spark.createDataFrame([("Choose from:  red , green or 　blue.",)], "t string").select(T.prompt_signals(F.col("t")).alias("s")).collect()
    assert r.s == ["one_of:red|green|blue"]


def test_block_digests_have_two_levels_at_any_size(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for n in (1, 3, 4, 20):
        want = []
        for name in "ab":
            level = [sha(f"{name}{k}") for k in range(n)]
            want.append(sha("".join(sha("".join(level[k : k + 3])) for k in range(0, n, 3))))
        rows = spark.createDataFrame([(k + 1, f"a{k}", f"b{k}") for k in range(n)], "at long, a string, b string").repartition(3)
        assert [tuple(r) for r in export.block_digests(rows, "at", ["a", "b"], width=3).collect()] == [(n, *want)]
    (r,) = export.block_digests(spark.createDataFrame([], "at long, a string"), "at", ["a"]).collect()
    assert tuple(r) == (0, None)


def test_digests_like_their_sql_below_one_block(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("e02_digests", "e05_results"):
        con = duckdb.connect()
        for t in ("events", "documents", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(SQL[name]).fetchall()
        assert [tuple(r) for r in QUERIES[name](spark, sf).collect()] == want


def test_divergence_by_brute_force(spark):
    """Drawn chains, repeated rows among them; a chain is sent once."""
    rng = random.Random(4)
    rows = [(rng.randrange(60), k, [rng.choice("ab") for _ in range(rng.randrange(5))]) for k in range(200)]
    want = {}
    for occ in {o for o, _, _ in rows}:
        chains = [c for o, _, c in sorted(rows) if o == occ]
        apart = [i for i, x in enumerate(chains[0]) if any(c[i : i + 1] != [x] for c in chains)]
        want[occ] = (apart[0], chains[0][apart[0]]) if apart else (None, None)
    found = sites.divergence(spark.createDataFrame(rows + rows[::7], "occ int, alt int, chain array<string>"))
    assert {r.occ: (r.at, r.id) for r in found.collect()} == want
    assert found._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan")[0].count("Exchange") == 1


def test_report_by_brute_force(spark, monkeypatch):
    """Drawn records, half of them of one id; each of the two orders is one shuffle."""
    rng = random.Random(6)
    rows = [(k, rng.choice(["occurrence", "occurrence", "wrapper_definition"]), rng.choice("fg"), rng.randrange(3), rng.randrange(5), rng.choice(["x", "x", "y", "z"])) for k in range(400)]
    numbers, names = {}, {}
    for at, kind, file, line, byte, id_ in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[4] if r[1] != "occurrence" else 0, r[0])):
        numbers[id_] = numbers.get(id_, 0) + 1
        names[at] = id_ if numbers[id_] == 1 else f"{id_}-{numbers[id_]}"
    want = [(at, names[at], k + 1) for k, (_, _, _, _, at) in enumerate(sorted((r[2], r[3], r[5], r[1], r[0]) for r in rows))]
    plans, write = [], rank.materialize
    monkeypatch.setattr(rank, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    got = sites.report(spark.createDataFrame(rows, "at long, kind string, file string, line int, byte int, id string"))
    assert sorted((r.at, r.unique_id, r.position) for r in got.collect()) == sorted(want)
    assert [(p.count("Exchange rangepartitioning"), "row_number" in p) for p in plans] == [(1, False)] * 2


def test_blocks_count_falls_and_sums(spark):
    rng = random.Random(8)
    for n in (0, 1, 3, 4, 50):
        keys = [rng.choice(["a", "b", "c", None]) if k % 5 else f"k{k}" for k in range(n)]
        want = sum(a is not None and b is not None and a >= b for a, b in zip(keys, keys[1:], strict=False))
        rows = spark.createDataFrame([(k + 1, x, f"t{k}", k % 2) for k, x in enumerate(keys)], "at long, key string, t string, odd int").repartition(3)
        (r,) = export.block_digests(rows, "at", ["t"], width=3, rising="key", sums=("odd",)).collect()
        (plain,) = export.block_digests(rows, "at", ["t"], width=3).collect()
        assert (r.n, r.falls, r.odd, r.t) == (n, want, n // 2, plain.t)


def test_verify_reads_each_text_once(spark, monkeypatch):
    """The clean and the planted export: no table is written but in its order, and JSON goes to Python once to be verified."""
    written = []
    for module in (exports, rank):
        monkeypatch.setattr(module, "materialize", lambda df, name, write=module.materialize: written.append(name) or write(df, name))
    clean = QUERIES["e03_verify_clean"](spark, "/root/testdata/sf0.001")
    assert written == ["ranked", "results"] and not any(r.n for r in clean.collect())
    plan = clean._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan")[0]
    assert plan.count("ArrowEvalPython") == 2  # of the rows, and of the one row of results
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    planted = QUERIES["e04_verify_planted"](spark, "/root/testdata/sf0.001")
    assert written == ["ranked", "results"] * 2 + ["ranked"]
    assert sorted(tuple(r) for r in planted.collect()) == sorted(con.execute(SQL["e04_verify_planted"]).fetchall())

import duckdb
import numpy as np
import pytest

from sparkgate.llm.vectors import OP1_SQL, SLACK, blocks_of, budgets, near_vectors, op1_subspace_vectors, rotation, slack


def brute(rows, least=0.98):
    ok = [i for i, (_, e, lab) in enumerate(rows) if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    n[i] += 1
                    root[find(i)] = find(j)
    best = {}
    for i in range(len(rows)):
        best[find(i)] = min(best.get(find(i), 1 << 62), rows[i][0])
    return sorted((rows[i][0], n[i], best[find(i)], best[find(i)] == rows[i][0]) for i in range(len(rows)))


def data():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        c = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 7))):
            rows.append((c + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.13, 0.3])).tolist())
    hub = rng.standard_normal(16)
    rows += [(hub + rng.standard_normal(16) * 0.1).tolist() for _ in range(120)] + [(3 * hub).tolist()] * 3
    out = [(i * 3, [float(np.float32(x)) for x in e], int(i % 2) if i < 150 else 1) for i, e in enumerate(rows)]
    bad = [[0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], None, [], [1.0, 2.0], [2.0, 4.0]]
    out += [(9000 + i, e, 1) for i, e in enumerate(bad)] + [(9100, out[0][1], None), (0, out[0][1], out[0][2])]
    return out


@pytest.mark.parametrize("tile", [2048, 40])
def test_links_and_components_match_brute_force(spark, tile):
    rows = data()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, row int").repartition(3)
    assert sorted(tuple(r) for r in near_vectors(df, tile=tile).collect()) == brute(rows)


def test_double_vectors_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (None, [1.0, 0.1], "x"), (3, [0.0, 1.0], "x")], "vec_id long, embedding array<double>, label string")
    got = near_vectors(df).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 1, 1, False), (1, 1, 1, True), (3, 0, 3, True)]
    assert near_vectors(df.limit(0)).count() == 0


def test_many_near_vectors_of_one_label(spark):
    """50,000 vectors that all link: copies are counted, not compared. Then 20,000 in groups of four, so many that cells split."""
    rng = np.random.default_rng(6)
    near = rng.standard_normal(32) + rng.standard_normal((1000, 32)) * 0.02
    rows = [(k, near[k % 1000].tolist(), 1) for k in range(50_000)]
    centres = np.repeat(rng.standard_normal((5000, 32)), 4, axis=0) + rng.standard_normal((20_000, 32)) * 1e-3
    rows += [(100_000 + k, c.tolist(), 2) for k, c in enumerate(centres)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tile=1500).collect()
    assert len(got) == 70_000
    for r in got:
        assert (r.n_links, r.component_id) == ((49_999, 0) if r.vec_id < 50_000 else (3, 100_000 + (r.vec_id - 100_000) // 4 * 4))


def test_very_long_vectors(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(4096)
    rows = [(1, one.tolist(), 1), (2, (one + 0.01 * rng.standard_normal(4096)).tolist(), 1), (3, rng.standard_normal(4096).tolist(), 1), (4, [1.0], 1), (5, [2.0], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)]


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op1_subspace_vectors(spark, sf).collect()) == sorted(con.execute(OP1_SQL).fetchall())


@pytest.mark.parametrize("dim", [256, 1024])
def test_pairs_at_the_edge_of_a_budget_are_linked(spark, dim):
    """Nearly all of both vectors lies in one block after the rotation, and the pair is just within that block's budget: single precision alone would lose some."""
    rng = np.random.default_rng(9)
    allowed, cut = budgets(dim, 4, 0.98)[0] - SLACK, blocks_of(dim, 4)[0]
    rows = []
    for pair in range(150):
        u, away = (rng.standard_normal(cut.stop) for _ in range(2))
        u /= np.linalg.norm(u)
        away -= (away @ u) * u
        angle = 2 * np.arcsin(np.sqrt(allowed * (1 - 1e-9)) / 2)
        v = np.cos(angle) * u + np.sin(angle) * away / np.linalg.norm(away)
        for k, part in enumerate((u, v)):
            whole = np.zeros(dim)
            whole[cut] = part
            rows.append((2 * pair + k, (rotation(dim) @ whole).tolist(), pair))
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [r.vec_id for r in got if r.n_links != 1] == []


def test_slack_covers_single_precision():
    rng = np.random.default_rng(10)
    for dim in (16, 256, 4096):
        for gap in (1e-3, 0.01, 0.2):
            u = rng.standard_normal(dim)
            u /= np.linalg.norm(u)
            v = u + gap * (w := rng.standard_normal(dim)) / np.linalg.norm(w)
            a, b = (x.astype(np.float32).astype(np.float64) for x in (u, v))
            assert abs(((a - b) ** 2).sum() - gap**2) <= 1.5 * slack(gap**2)


def test_clashing_columns_and_nothing_left_behind(spark):
    from pathlib import Path

    from sparkgate.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    rows = [(1, [1.0, 0.0], 1, 5, "n"), (2, [1.0, 0.01], 1, 6, "c"), (3, [0.0, 1.0], 1, 7, "x")]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row int, class string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert [p.name.split("-")[1] for p in set(folder.iterdir()) - before] == ["links"]

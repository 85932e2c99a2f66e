import math

import numpy as np
from pyspark.sql import functions as F

from sparkgate.llm.whitening import deviations, op13_svd_whitening, whitened

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>"


def plain(vectors: list[list[float]], most: int = 4):
    """(x, n, sums, eigenvalues, components) by numpy."""
    x = np.floor(256 * np.array(vectors, dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    away = fit - sums / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    return x, n, sums, values[::-1], axes[:, ::-1]


def compare(got: list, ids: list, vectors: list[list[float]], most: int = 4) -> None:
    x, n, sums, values, axes = plain(vectors)
    assert len(got) == len(ids) * most
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), r)
    signs = {}
    for vec_id, row in zip(ids, x):
        for k in range(most):
            r = by[vec_id, k + 1]
            assert r.n == n and int(r.deviation) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
            want = float((row - sums / n) @ axes[:, k] / math.sqrt(values[k]))
            sign = signs.setdefault(k, math.copysign(1, r.whitened * want))
            assert abs(r.whitened - sign * want) < 1e-8
            assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-10
            assert r.identity_error < 1e-9


def test_embeddings_like_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    compare(op13_svd_whitening(spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_repeats_are_fitted_once_and_bad_vectors_dropped(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((60, 8)) * [9, 7, 5, 3, 1, 1, 1, 1] - 40).tolist()
    rows = [(k, v) for k, v in enumerate(vectors)] + [(100 + k, vectors[0]) for k in range(30)] + [(200, [-0.0] * 8)]
    good = list(rows)
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, [1e300] * 8)]
    docs = spark.createDataFrame(good + bad, VECTORS).repartition(5).withColumn("x", F.lit(1)).withColumn("component", F.lit("c")).withColumn("label", F.lit(None))
    compare(whitened(docs).collect(), [k for k, _ in good], [v for _, v in good])


def test_rows_that_repeat_an_id_or_have_none_stay(spark):
    rng = np.random.default_rng(4)
    rows = [(None if k % 3 else 7, rng.standard_normal(6).tolist()) for k in range(30)]
    got = whitened(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 120 and sum(r.vec_id is None for r in got) == 80


def test_directions_without_variance_make_no_component(spark):
    line = [(k, [float(k), 2.0 * k, 5.0, 1.0]) for k in range(9)]
    got = whitened(spark.createDataFrame(line, VECTORS)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    assert whitened(spark.createDataFrame(line[:1] * 4, VECTORS)).count() == 0
    assert whitened(spark.createDataFrame(line, VECTORS).where("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitened(spark.createDataFrame(line, VECTORS).where("false")).count() == 0


def test_each_length_is_fitted_apart(spark):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((20, 5)).tolist(), rng.standard_normal((30, 7)).tolist()
    got = whitened(spark.createDataFrame([*enumerate(a), *((100 + k, v) for k, v in enumerate(b))], VECTORS)).collect()
    compare([r for r in got if r.vec_id < 100], list(range(20)), a)
    compare([r for r in got if r.vec_id >= 100], list(range(100, 130)), b)


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[1 << 50, -(1 << 50)], [3, 5]], dtype=np.int64)
    n, sums = 10**9, [10**17 + 1, -(10**18)]
    assert deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]


def test_long_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.standard_normal((300, 200)) * np.linspace(3, 0.2, 200)).tolist()
    compare(whitened(spark.createDataFrame(list(enumerate(vectors)), VECTORS)).collect(), list(range(300)), vectors)

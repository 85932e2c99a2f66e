"""Whitening of embeddings by a singular value decomposition of centred distributed rows."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgate.session import drop_materialized, materialize

#: Singular values below this part of the largest are rounding and make no component.
LEAST_SINGULAR = 1e-6
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def scaled(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the usable vectors: x = floor(scale * entry) of the entries as double. Null and empty vectors go, as do those with null
    or non-finite entries or entries that x can't hold in 62 bits."""
    vector = F.col(vector_col).cast("array<double>")
    held = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 62)))
    usable = vectors.where(F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & held, F.lit(False)))
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _rows(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def _dot(x: np.ndarray, s: list[int]) -> np.ndarray:
    """The exact inner products of rows with s: in 64 bits where they fit, else in Python's integers."""
    most = int(np.abs(x).max(initial=0)) * max(map(abs, s), default=0) * len(s)
    if most < 1 << 62:
        return x @ np.array(s, dtype=np.int64)
    return x.astype(object) @ np.array(s, dtype=object)


def _squares(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0)) ** 2 * x.shape[1]
    x = x if most < 1 << 62 else x.astype(object)
    return (x * x).sum(axis=1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2 of each row: n^2 sum x^2 - 2 n sum x S + sum S^2."""
    rest = sum(s * s for s in sums)
    return [n * n * a - 2 * n * b + rest for a, b in zip(_squares(x).tolist(), _dot(x, sums).tolist())]


def _sums(fit: DataFrame, dim: int) -> list[int]:
    """The exact sum of each dimension: a row per dimension and batch, added up by Spark. Upper and lower 31 bits apart, so that nothing passes 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(0), dim)
            parts = [np.arange(dim, dtype=np.int32), (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["at", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
    rows = fit.select("x").mapInArrow(run, "at int, high long, low long").groupBy("at").agg(wide("high"), wide("low")).orderBy("at").collect()
    return [(int(r.high) << 31) + int(r.low) for r in rows]


def _total(fit: DataFrame, dim: int, n: int, sums: list[int]) -> int:
    """The exact sum of the deviations of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = deviations(_rows(batch.column(0), dim), n, sums)
            yield pa.RecordBatch.from_arrays([pa.array([str(sum(found))])], names=["d"])

    whole = fit.select("x").mapInArrow(run, "d string").select(F.col("d").cast("decimal(38,0)").alias("d"))
    return int(whole.agg(F.coalesce(F.sum("d"), F.lit(0))).head()[0])


def components(fit: DataFrame, dim: int, n: int, sums: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as columns, eigenvalues) of the covariance of fit (x), divisor n, by computeSVD on its centred rows: a squared singular value is n times an eigenvalue.

    All dim components are asked for, so that the decomposition is a full one in double precision and no iteration.
    """
    mean = F.array(*[F.lit(s / n) for s in sums])
    rows = fit.select(array_to_vector(F.zip_with(F.col("x").cast("array<double>"), mean, lambda x, m: x - m)).alias("row"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), n, dim).computeSVD(dim, computeU=False, rCond=LEAST_SINGULAR)
    values = np.array(svd.s.toArray())[:most]
    return svd.V.toArray()[:, : len(values)], values**2 / n


def _whitened(dim: int, n: int, sums: list[int], axes: np.ndarray, values: np.ndarray):
    """Projections of rows x on the components, over the roots of their eigenvalues."""
    mean = np.array([s / n for s in sums])
    turn = axes / np.sqrt(values)
    return lambda x: (x.astype(np.float64) - mean) @ turn


def _of_length(rows: DataFrame, dim: int, most: int) -> DataFrame | None:
    fit = materialize(rows.select("x").distinct(), "whitening")
    n, sums = fit.count(), _sums(fit, dim)
    total = _total(fit, dim, n, sums)
    if total == 0:  # one vector, again and again: nothing varies
        drop_materialized(fit)
        return None
    axes, values = components(fit, dim, n, sums, most)
    project, count = _whitened(dim, n, sums, axes, values), len(values)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = project(_rows(batch.column(0), dim))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(count)], names=[f"w{k}" for k in range(count)])

    white = fit.select("x").mapInArrow(fitted, ", ".join(f"w{k} double" for k in range(count)))
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    found = white.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).head()
    error = max(abs(found[k] - (a == b)) for k, (a, b) in enumerate(pairs))
    drop_materialized(fit)
    # The trace of the covariance is total / n^3.
    explained = [float(Decimal(float(e)) * n * n * n / total) for e in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), dim)
            w = project(x)
            away = [Decimal(d) if d < 10**38 else None for d in deviations(x, n, sums)]
            size = len(x) * count
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array([n] * size, pa.int64())]
            columns += [pa.array([d for d in away for _ in range(count)], pa.decimal128(38, 0)), pa.array(w.reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array([error] * size, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)


def whitened(vectors: DataFrame, most: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable vector and component up to `most`.

    Entries become integers x = floor(scale * entry). The fit list holds each distinct x once: n vectors with sums S, all counted exactly. Their rows
    less S / n go to a distributed matrix, whose singular values and right vectors give the eigenvalues (their squares over n) and components of the covariance.
    deviation is the exact sum of (n x - S)^2 (null from 10^38), whose total gives the trace that explained divides by; whitened is the projection of
    x - S / n over the root of the eigenvalue; identity_error the largest entry of whitened's covariance over the fit list, less the identity.

    Vectors that are null or empty, or hold null, non-finite or very large entries (scaled() has the rule), give no row. Vectors of different lengths are fitted apart, each
    length with its own components. Where all are equal there is none, nor in directions without variance: no row. An empty table gives an empty
    result. Rows that repeat an id, or have none, stay rows. Other columns are not carried. The driver holds S and a square matrix of the vectors' length, whatever their number.
    """
    rows = scaled(vectors, scale, id_col, vector_col)
    lengths = [r[0] for r in rows.select(F.size("x").alias("dim")).distinct().collect()]
    parts = [p for dim in sorted(lengths) if (p := _of_length(rows.where(F.size("x") == dim), dim, most)) is not None]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], OUT)


def op13_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))

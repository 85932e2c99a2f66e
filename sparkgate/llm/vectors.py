"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgate.operators.components import connected_components
from sparkgate.session import materialize, settled

#: Blocks of the rotated space, how many leading dimensions of a block make its grid (and how many more split a cell that is too full), the
#: grid's cell width in budget radii, and the most vectors that a task compares at once on either side.
BLOCKS, GRID, WIDTH, TILE = 4, 3, 2.5, 4096
SLACK = 1e-12
KEY = ["label", "dim", "block", "cell"]
CELL = ", ".join(["label string", "dim int", "block int", "cell long", "home boolean", "node long", "part binary"])


@cache
def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix, so that no direction of the input is special to a block."""
    q, r = np.linalg.qr(np.random.default_rng(20240501).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, blocks: int) -> list[slice]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def budgets(dim: int, blocks: int, least_cosine: float) -> np.ndarray:
    """Squared distance allowed in each block, in proportion to its dimensions. Unit vectors with that cosine are at squared
    distance 2 - 2 * cosine; if every block took more than its part, so would the whole."""
    return np.array([(2 - 2 * least_cosine) * (s.stop - s.start) / dim + SLACK for s in blocks_of(dim, blocks)])


def slack(budget: float) -> float:
    """What single-precision coordinates, and sums in double precision, may add to a squared distance that is within the budget.

    Rounding moves a coordinate by at most 2^-24 of itself, so each of two unit vectors by 2^-24 at most in any number of dimensions, and their distance by 2^-23.
    """
    return 2 * np.sqrt(budget) * 2.0**-23 + 2.0**-46 + SLACK


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _cells(part: np.ndarray, budget: float, width: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cell numbers, home?) of a grid: the cell each point is in, then every later cell that its budget ball reaches.

    Of two points within the budget in different cells, exactly one reaches the other's cell as a later one, so each pair meets once.
    """
    side = width * np.sqrt(budget)
    x = part / side
    home = np.floor(x)
    below = (x - home) * side
    for offset in product((0, 1, -1), repeat=x.shape[1]):
        o = np.array(offset)
        first = o[np.flatnonzero(o)[:1]]
        if len(first) and first[0] < 0:
            continue
        gap = np.where(o < 0, below, np.where(o > 0, side - below, 0.0))
        (rows,) = np.nonzero((gap * gap).sum(axis=1) <= budget * (1 + 1e-6) + slack(budget))
        if len(rows):
            cell = np.zeros(len(rows), dtype=np.int64)
            for k in range(x.shape[1]):
                cell = cell * 4001 + (home[rows, k] + o[k]).astype(np.int64) + 2000
            yield rows, cell, not any(offset)


def _spread(least_cosine: float, blocks: int, grid: int, width: float, kind: str):
    """(label, node, raw) as a row per block and reached cell, with the coordinates of that block only."""
    names = [x.split()[0] for x in CELL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ids, raws = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for k, raw in enumerate(raws):
                by_dim.setdefault(len(raw) // np.dtype(kind).itemsize, []).append(k)
            for dim, own in by_dim.items():
                at = np.array(own)
                rotated = _units(np.frombuffer(b"".join(raws[k] for k in own), dtype=kind).reshape(len(own), dim).astype(np.float64)) @ rotation(dim)
                for b, (cut, budget) in enumerate(zip(blocks_of(dim, blocks), budgets(dim, blocks, least_cosine))):
                    parts = [x.tobytes() for x in rotated[:, cut].astype("<f4")]
                    for rows, cell, home in _cells(rotated[:, cut][:, :grid], budget, width):
                        n, take = len(rows), pa.array(at[rows])
                        yield pa.RecordBatch.from_arrays([labels.take(take), pa.array([dim] * n, pa.int32()), pa.array([b] * n, pa.int32()), pa.array(cell), pa.array([home] * n), ids.take(take), pa.array([parts[r] for r in rows], pa.binary())], names=names)

    return run


def _split(least_cosine: float, blocks: int, grid: int, width: float):
    """Rows of cells that are too full with inner and inner_home: a grid over the next dimensions of the block, by the same rule."""
    names = [*(x.split()[0] for x in CELL.split(", ")), "inner", "inner_home"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, numbers = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for dim, block in set(zip(dims.tolist(), numbers.tolist())):
                (own,) = np.nonzero((dims == dim) & (numbers == block))
                raw = batch.column(6).take(pa.array(own)).to_pylist()
                part = np.frombuffer(b"".join(raw), dtype="<f4").reshape(len(own), -1)[:, grid : 2 * grid].astype(np.float64)
                cells = _cells(part, budgets(dim, blocks, least_cosine)[block], width) if part.shape[1] else [(np.arange(len(own)), np.zeros(len(own), dtype=np.int64), True)]
                for rows, cell, home in cells:
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own[rows])) for c in batch.columns), pa.array(cell), pa.array([home] * len(rows))], names=names)

    return run


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable from each of n nodes over edges u - v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


TILED = ["label", "dim", "block", "cell", "inner", "q", "t"]
ROLES = ["home", "inner_home", "own", "node"]


def _near(table: pa.Table, part: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (u, v) of places of a tile within the budget in its block, each pair of the tile once.

    Pairs are of one vector of row q and one of row t of the tiles. Two that only visit the cell meet elsewhere.
    """
    own, q, t = table["own"].to_numpy(), table["q"][0].as_py(), table["t"][0].as_py()
    home, inner = (table[c].to_numpy(zero_copy_only=False) for c in ("home", "inner_home"))
    left, right = np.flatnonzero(own == q), np.flatnonzero(own == t)
    square = (part * part).sum(axis=1)
    for k in range(0, len(left), 512):
        u = left[k : k + 512]
        near = square[u][:, None] + square[right][None, :] - 2 * part[u] @ part[right].T <= budget + slack(budget)
        near &= (home[u][:, None] | home[right][None, :]) & (inner[u][:, None] | inner[right][None, :])
        if q == t:
            near &= u[:, None] < right[None, :]
        i, j = np.nonzero(near)
        for s in range(0, len(i), 1 << 16):
            yield u[i[s : s + (1 << 16)]], right[j[s : s + (1 << 16)]]


def _candidates(least_cosine: float, blocks: int):
    """Range join of one tile in its block: the vectors that are within the budget of another one."""

    def run(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        part = np.frombuffer(b"".join(table["part"].to_pylist()), dtype="<f4").reshape(table.num_rows, -1).astype(np.float64)
        some = np.zeros(table.num_rows, dtype=bool)
        for u, v in _near(table, part, budgets(dim, blocks, least_cosine)[block]):
            some[u] = some[v] = True
        return table.select([*TILED, *ROLES]).filter(pa.array(some))

    return run


def _links(least_cosine: float, blocks: int, kind: str):
    """The exact check of the candidates of one tile: how many links each vector has there, and a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        unit = _units(np.frombuffer(b"".join(table["raw"].to_pylist()), dtype=kind).reshape(len(node), dim).astype(np.float64))
        rotated = unit @ rotation(dim)
        cuts, budget = blocks_of(dim, blocks), budgets(dim, blocks, least_cosine)
        count = np.zeros(len(node), dtype=np.int64)
        us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for u, v in _near(table, rotated[:, cuts[block]], budget[block]):
            keep = (unit[u] * unit[v]).sum(axis=1) >= least_cosine
            u, v = u[keep], v[keep]
            # A pair belongs to the first block in which it is within the budget.
            gap = (rotated[u] - rotated[v]) ** 2
            inside = np.stack([gap[:, c].sum(axis=1) <= b for c, b in zip(cuts[: block + 1], budget)]) if len(u) else np.zeros((block + 1, 0), dtype=bool)
            keep = inside[block] & ~inside[:block].any(axis=0)
            u, v = u[keep], v[keep]
            np.add.at(count, u, copies[v])
            np.add.at(count, v, copies[u])
            us.append(u)
            vs.append(v)
        root = spanning(np.concatenate(us), np.concatenate(vs), len(node))
        (linked,) = np.nonzero(count)
        (child,) = np.nonzero(root != np.arange(len(node)))
        return pa.table({"a": pa.array(np.concatenate([node[linked], node[child]])), "b": pa.array(np.concatenate([count[linked], node[root[child]]])), "link": pa.array(np.concatenate([np.zeros(len(linked), dtype=bool), np.ones(len(child), dtype=bool)]))})

    return run


def _tiled(cells: DataFrame, least_cosine: float, blocks: int, grid: int, width: float, tile: int) -> DataFrame:
    """cells as tiles: TILED, ROLES and part. Cells of more than `tile` vectors are split by an inner grid, and what is still too full is dealt to a triangle of tiles."""
    hot = materialize(cells.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > tile).drop("n"), "hot")
    plain = cells.withColumns({"inner": F.lit(0).cast("long"), "inner_home": F.lit(True), "q": F.lit(0), "t": F.lit(0), "own": F.lit(0)}).select(*TILED, *ROLES, "part")
    if hot.isEmpty():
        return plain
    full = cells.join(hot, KEY, "left_semi").select(*[x.split()[0] for x in CELL.split(", ")])
    full = materialize(full.mapInArrow(_split(least_cosine, blocks, grid, width), f"{CELL}, inner long, inner_home boolean"), "full")
    parts = full.groupBy(*KEY, "inner").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")).where("parts > 1")
    dealt = full.join(materialize(parts, "parts"), [*KEY, "inner"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("q"), F.greatest(p, F.col("own")).alias("t")))
    tiles = dealt.withColumn("p", F.explode(pairs)).select(*KEY, "inner", "p.q", "p.t", *ROLES, "part")
    return plain.join(hot, KEY, "left_anti").select(*tiles.columns).unionByName(tiles)


def near_vectors(vectors: DataFrame, least_cosine: float = 0.98, blocks: int = BLOCKS, grid: int = GRID, width: float = WIDTH, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links are pairs of equal labels with cosine >= least_cosine in double precision.

    1. Equal vectors of a label are one node with a number of copies, so copies are never compared.
    2. Unit vectors are turned by a fixed rotation and split into blocks. A linked pair is within its proportional squared-distance
       budget in at least one block, so each block is range-joined alone: a grid over the block's leading dimensions brings together a vector's
       cell with the vectors whose budget ball reaches it. Only the block's coordinates travel. Cells that are too full are split by a
       grid over the next dimensions, and what is still too full is dealt to tiles of about `tile` by `tile` vectors.
    3. Whole vectors travel for nodes within the budget of another one only. The exact check counts a pair in the first block that finds
       it. A tile sends one count per node and a spanning forest of its links, never its pairs.

    component_id is the smallest vec_id reachable over links, kept says that it is the vector's own. Null, empty and zero vectors, and those
    with null or non-finite components, link with nothing, as do null labels and vectors of different lengths. Rows that repeat an id are vectors of
    their own. A null id counts as a vector but never names a component that has another id. An empty table gives an empty result. Other columns are not carried.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    element = "float" if kind == "<f4" else "double"
    vector = F.col(vector_col).cast(f"array<{element}>")
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(label_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & numbers & F.exists(vector, lambda x: x != 0)
    read = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(F.coalesce(usable, F.lit(False)), vector).alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(2).to_pylist()
            raw = [None if v is None else np.array(v, dtype=kind).tobytes() for v in batch.column(3).to_pylist()]
            digest = [None if r is None else hashlib.blake2b(x.encode() + b"\0" + r, digest_size=16).digest() for x, r in zip(labels, raw)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary()), pa.array(digest, pa.binary())], names=["row", "vec_id", "label", "raw", "class"])

    rows = read.mapInArrow(packed, "row long, vec_id long, label string, raw binary, class binary")
    return settled(lambda: _linked(rows, least_cosine, blocks, grid, width, tile, kind), vectors.sparkSession, "links")


def _linked(rows: DataFrame, least_cosine: float, blocks: int, grid: int, width: float, tile: int, kind: str) -> DataFrame:
    base = materialize(rows, "vectors")
    nodes = base.where("class is not null").groupBy("class").agg(F.min(F.struct("row", "label", "raw")).alias("x"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes.select("class", F.col("x.row").alias("node"), "x.label", "x.raw", "least", "copies"), "nodes")
    cells = nodes.select("label", "node", "raw").mapInArrow(_spread(least_cosine, blocks, grid, width, kind), CELL)
    tiles = _tiled(cells, least_cosine, blocks, grid, width, tile)
    roles = "label string, dim int, block int, cell long, inner long, q int, t int, home boolean, inner_home boolean, own int, node long"
    near = tiles.groupBy(*TILED).applyInArrow(_candidates(least_cosine, blocks), roles)
    found = near.join(nodes.select("node", "raw", "copies"), "node").groupBy(*TILED).applyInArrow(_links(least_cosine, blocks, kind), "a long, b long, link boolean")
    found = materialize(found, "found")
    counts = found.where("not link").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    parts = materialize(connected_components(found.where("link").select("a", "b")).withColumnRenamed("id", "node"), "parts")
    known = nodes.select("class", "node", "least", "copies").join(parts, "node", "left").join(counts, "node", "left")
    lowest = known.where("component is not null").groupBy("component").agg(F.min("least").alias("low"))
    links = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    named = known.join(lowest, "component", "left").select(F.col("class").alias("_class"), links.alias("_links"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("low")).alias("_low"))
    out = base.select("vec_id", "class").join(named, F.col("class") == F.col("_class"), "left")
    component = F.coalesce("_low", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op1_subspace_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS c FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

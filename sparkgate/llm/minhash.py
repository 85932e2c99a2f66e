"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgate.operators.components import connected_components
from sparkgate.llm.vectors import spanning
from sparkgate.session import drop_materialized, materialize

SHINGLE = 5
#: The signature: CHUNKS chunks of WIDTH symbols of BITS bits. Each chunk may differ in ERRORS symbols, so all pairs with at most
#: CHUNKS * (ERRORS + 1) - 1 = 21 of the 55 symbols different share a key, and of the pairs beyond most do: a pair of similarity s misses
#: every key with probability (1 - s**5 - 5 * (1 - s) * s**4) ** 11: 1.7e-5 at 0.75, 5e-7 at 0.8.
CHUNKS, WIDTH, ERRORS, BITS = 11, 5, 1, 16
#: One more bit of each of SKETCH hash functions is compared before full sets are: candidates that differ in more than FAR of them
#: are given up. A bit differs with probability (1 - s) / 2, so that loses a pair of similarity 0.75 or more with
#: probability 1.3e-7 at most (far_loss), a hundredth of what the keys miss.
SKETCH, FAR = 128, 38
#: Up to how many members a bucket lists its pairs, and the most members that meet on either side of one task.
FEW, TILE = 16, 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 4 * SKETCH + 600, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE = _SEEDS[:256]
_SALT = _SEEDS[256 : 256 + SKETCH]
_ODD = _SEEDS[256 + SKETCH : 256 + 2 * SKETCH] | np.uint64(1)
_PLACE = _SEEDS[256 + 2 * SKETCH : 256 + 2 * SKETCH + SHINGLE] | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        step = _powers[-1:] * _BASE
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, A-Z lower-cased: words `[^\\x20\\x09-\\x0D]+` in order."""
    codes = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    if not len(codes):
        return np.zeros(0, dtype=np.uint64)
    space = _SPACES[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    # The hash of a word is its polynomial from the right end, so that it doesn't depend on where the word stands.
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[codes] * _power(len(codes)), dtype=np.uint64)])
    total = run[end] - run[start]
    return _mix(total * _inverse(start) + (end - start).astype(np.uint64))


_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_backs = np.ones(1, dtype=np.uint64)


def _inverse(at: np.ndarray) -> np.ndarray:
    """The inverse of the base to each power."""
    global _backs
    while len(_backs) <= at[-1]:
        step = _backs[-1:] * _BACK
        _backs = np.concatenate([_backs, _backs * step])
    return _backs[at]


def shingle_hashes(raw: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; a shorter text is one shingle, a text without words none."""
    w = word_hashes(raw)
    if not len(w):
        return w
    n = min(len(w), SHINGLE)
    h = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        h += w[k : len(w) - n + 1 + k] * _PLACE[k]
    return np.unique(_mix(h + np.uint64(n)))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols [rows, CHUNKS * WIDTH] of BITS bits, sketch [rows, 2]) of sets that are not empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.stack([np.minimum.reduceat((flat ^ salt) * odd, at) for salt, odd in zip(_SALT, _ODD)], axis=1)
    least = _mix(least)
    symbols = (least[:, : CHUNKS * WIDTH] >> np.uint64(8)) & np.uint64((1 << BITS) - 1)
    bits = (least & np.uint64(1)).astype(np.uint8)
    return symbols, np.packbits(bits, axis=1).view(np.uint64)


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """[rows, keys]: for each chunk and each choice of ERRORS symbols to leave out, a hash of the others."""
    out = []
    for c in range(CHUNKS):
        for left in combinations(range(WIDTH), ERRORS):
            h = np.full(len(symbols), (c * 1000 + sum(7**k * (x + 1) for k, x in enumerate(left))), dtype=np.uint64)
            for k in range(WIDTH):
                if k not in left:
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + symbols[:, c * WIDTH + k])
            out.append(h)
    return np.stack(out, axis=1)


def far_loss(similarity: float) -> float:
    """How likely a pair of this similarity differs in more than FAR of SKETCH bits: a binomial tail."""
    q = (1 - similarity) / 2
    return sum(comb(SKETCH, k) * q**k * (1 - q) ** (SKETCH - k) for k in range(FAR + 1, SKETCH + 1))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, raw, carried ...) as (id, n, class, s1, s2, symbols, carried ...)."""
    for batch in batches:
        names = [batch.schema.names[0], "n", "class", "s1", "s2", "symbols", *batch.schema.names[2:]]
        for part in range(0, batch.num_rows, 300):
            rows = batch.slice(part, 300)
            sets = [shingle_hashes(x or b"") for x in rows.column(1).to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            symbols: list[bytes | None] = [None] * len(sets)
            sketch = np.zeros((len(sets), 2), dtype=np.int64)
            if full:
                own, bits = signatures([sets[k] for k in full])
                sketch[full] = bits.view(np.int64)
                for k, x in zip(full, own.astype("<u2")):
                    symbols[k] = x.tobytes()
            digest = [_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.array(symbols, pa.binary()), *rows.columns[2:]], names=names)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, symbols) as (node, key), a row per index key."""
    for batch in batches:
        for part in range(0, batch.num_rows, 2000):
            rows = batch.slice(part, 2000)
            symbols = np.frombuffer(b"".join(rows.column(1).to_pylist()), dtype="<u2").reshape(-1, CHUNKS * WIDTH)
            keys = index_keys(symbols.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], names=["node", "key"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(raw, class, node, cluster, parts) as (node, cluster, parts, set): rows whose text is not of that class are another row of the same id."""
    for batch in batches:
        for part in range(0, batch.num_rows, 300):
            rows = batch.slice(part, 300)
            sets = [shingle_hashes(x or b"") for x in rows.column(0).to_pylist()]
            own = [k for k, (s, c) in enumerate(zip(sets, rows.column(1).to_pylist())) if _digest(s) == c]
            flat = pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *[sets[k] for k in own]]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(sets[k]) for k in own])]), pa.int32()), flat)
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(2).take(at), rows.column(3).take(at), rows.column(4).take(at), lists], names=["node", "cluster", "parts", "set"])


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[len(x), len(y)]: in how many sketch bits rows of x and y differ."""
    return sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.int16) for k in range(2))


def _forest(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.Table:
    """A spanning forest (a, b) of the edges u - v between places of ids."""
    root = spanning(u, v, len(ids))
    (child,) = np.nonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[root[child]], pa.int64()), "b": pa.array(ids[child], pa.int64())})


def _near_in_bucket(table: pa.Table) -> pa.Table:
    """A spanning forest of the pairs of one tile of a bucket that are within FAR."""
    ids = table["id"].to_numpy()
    sketch = np.stack([table[c].to_numpy().view(np.uint64) for c in ("s1", "s2")], axis=1)
    query, target = (np.flatnonzero(table[c].to_numpy(zero_copy_only=False)) for c in ("query", "target"))
    us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for k in range(0, len(query), 256):
        i, j = np.nonzero(_differ(sketch[query[k : k + 256]], sketch[target]) <= FAR)
        us.append(query[k : k + 256][i])
        vs.append(target[j])
    return _forest(ids, np.concatenate(us), np.concatenate(vs))


def _links_in_cluster(percent: int):
    """A spanning forest of the links of one tile of a cluster, from full sets: the tile's inverted index gives all intersections of a query."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        lists = table["set"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        edges = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()[edges[0] : edges[-1]]
        edges = edges - edges[0]
        size = np.diff(edges)
        query, target = (table[c].to_numpy(zero_copy_only=False) for c in ("query", "target"))
        _, code = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), size)
        mine = target[owner]
        order = np.argsort(code[mine], kind="stable")
        posted = owner[mine][order]
        start = np.concatenate([[0], np.cumsum(np.bincount(code[mine], minlength=code.max(initial=-1) + 1))])
        us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for q in np.flatnonzero(query):
            common = np.zeros(len(ids), dtype=np.int64)
            for k in range(edges[q], edges[q + 1], 1024):  # at most TILE places of each shingle at once
                own = code[k : min(k + 1024, edges[q + 1])]
                n = start[own + 1] - start[own]
                common += np.bincount(posted[np.repeat(start[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())], minlength=len(ids))
            (v,) = np.nonzero((common > 0) & (100 * common >= percent * (size[q] + size - common)) & (np.arange(len(ids)) != q))
            us.append(np.full(len(v), q))
            vs.append(v)
        return _forest(ids, np.concatenate(us), np.concatenate(vs))

    return run


def _tiles(rows: DataFrame, key: str, *carried: str) -> DataFrame:
    """rows (key, node, parts, carried ...) dealt into tiles (q, t), q <= t, of their key's group: parts is how many rows of tiles the group has.

    A row is a query in the tiles of its own part with all later ones, and a target in those of its own part with all earlier ones.
    """
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("q"), F.greatest(p, F.col("own")).alias("t"), (p >= F.col("own")).alias("query"), (p <= F.col("own")).alias("target")))
    return dealt.select(key, F.col("node").alias("id"), *carried, F.explode(tile).alias("p")).select(key, "id", *carried, "p.*")


def _parts(n: str) -> Column:
    return F.ceil(F.col(n) / TILE).cast("int").alias("parts")


def near_duplicates(docs: DataFrame, percent: int = 75, text_col: str = "text", id_col: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, chosen) and the carried columns per row of docs.

    Documents are linked when 100 * intersection >= percent * union of their sets of 5-word shingles; component_id is the smallest
    id reachable over links and kept says that it is the document's own. chosen is true for one row of each group: the one with that
    id, or one of them if it repeats.

    1. Rows with equal sets form a class, of which one row is the node. Classes are linked by definition.
    2. Each node has a signature. Its chunks, each with every choice of ERRORS symbols left out, are the keys of a
       multi-index: a pair within the signature distance of CHUNKS * (ERRORS + 1) - 1 shares one. Keys are counted in a partial
       aggregate; only those that nodes share are joined back, so a hot key is split by the skew join.
    3. Pairs that share a key and differ in at most FAR sketch bits (see far_loss) are candidates. Buckets of at most FEW members list their pairs, at
       most FEW - 1 per member; larger ones send a spanning forest of theirs, made in tiles of TILE by TILE. Connected candidates form a cluster.
    4. The full sets of each cluster meet, in tiles again, and all links within a tile are found from its inverted index; a tile sends a
       spanning forest of its links.

    So no link is left out between documents that are candidates or connected by candidates, none is false, and what is sent grows with the members of a group, not with
    its pairs. Full sets are made again from the texts of clustered nodes only: texts are shuffled once, at any size.

    Rows stand for themselves: a repeated id with another text is another row. An id that is null has component null, links with nothing and is kept and
    chosen. A null or wordless text has no shingles and no links, and is chosen. An empty table gives an empty
    result. Other columns of docs are not carried.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("raw"), *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carried)])
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in read.schema.fields[2:])
    rows = read.mapInArrow(_prepare, f"id long, n long, class binary, s1 long, s2 long, symbols binary{kinds}")
    base = materialize(rows.withColumn("class", F.when(F.col("id").isNotNull(), F.col("class"))).withColumn("row", F.monotonically_increasing_id()), "signatures")
    least = F.min(F.struct("id", F.col("row").alias("node"), "s1", "s2", "symbols")).alias("x")
    classes = materialize(base.where("class is not null").groupBy("class").agg(least).select("class", "x.*"), "classes")

    keyed = classes.select("node", "symbols").mapInArrow(_keys, "node long, key long")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = materialize(keyed.join(shared, "key").join(classes.select("node", "s1", "s2"), "node"), "buckets")
    few = members.where(F.col("n") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    differ = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
    listed = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (differ <= FAR)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = members.where(F.col("n") > FEW).select("key", "node", "s1", "s2", _parts("n"))
    forests = _tiles(many, "key", "s1", "s2").groupBy("key", "q", "t").applyInArrow(_near_in_bucket, "a long, b long")
    clusters = materialize(connected_components(listed.union(forests).distinct()).select(F.col("id").alias("node"), F.col("component").alias("cluster")), "clusters")
    drop_materialized(members)
    drop_materialized(shared)

    big = materialize(clusters.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("cluster", _parts("n")), "big")
    sized = clusters.join(big, "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    wanted = materialize(sized.join(classes.select("node", "id", "class"), "node"), "wanted")
    # The merge hint keeps the plan the same at every size: texts are sent once, to the few columns about them.
    found = read.select("id", "raw").join(wanted.hint("merge"), read["id"] == wanted["id"]).select("raw", "class", "node", "cluster", "parts")
    sets = found.mapInArrow(_sets, "node long, cluster long, parts int, set array<long>")
    links = _tiles(sets, "cluster", "set").groupBy("cluster", "q", "t").applyInArrow(_links_in_cluster(percent), "a long, b long")
    parts = connected_components(links).withColumnRenamed("id", "node")

    # The least of a component, then the component of each class.
    own = F.struct("id", "node").alias("own")
    known = classes.select("class", "node", own).join(parts, "node", "left")
    lowest = known.where("component is not null").groupBy("component").agg(F.min("own").alias("low"))
    named = materialize(known.join(lowest, "component", "left").select("class", F.coalesce("low", "own").alias("low")).select(F.col("class").alias("_class"), F.col("low.id").alias("_low"), F.col("low.node").alias("_first")), "named")
    for table in (classes, clusters, big, wanted):
        drop_materialized(table)
    out = base.join(named, F.col("class") == F.col("_class"), "left")
    component = F.when(F.col("_class").isNull(), F.col("id")).otherwise(F.col("_low"))
    chosen = F.col("_class").isNull() | (F.col("row") == F.col("_first"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), chosen.alias("chosen"), *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carried)])


def op6_hamming_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("chosen")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

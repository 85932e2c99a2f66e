"""Phrase collocations by vertical positional inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgate.session import batches_of, drop_materialized, materialize, scratch_path

#: Words of a block, the unit whose lists are kept together (a text is never cut), blocks of a file, which bounds what a reader holds, and the most bits of a filter of frequent phrases.
BLOCK_WORDS, FILE_BLOCKS, FILTER_BITS = 1 << 16, 32, 1 << 28
#: Entries of counts that a task holds before it sends them on, and about how many words make a share of all counts.
HELD_COUNTS, SHARE_WORDS = 1 << 20, 1 << 20
#: Bytes of blocks that go to Python at once.
BATCH_BYTES = 1 << 22
#: Ends of pieces become a word of their own, which no text can hold; tabs become spaces.
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
FIELDS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("phrases", pa.list_(pa.string())), ("hashes", pa.binary()), ("last", pa.binary()), ("lengths", pa.binary()), ("positions", pa.binary())])
LISTS = "block long, lang string, phrases array<string>, hashes binary, last binary, lengths binary, positions binary"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32 in little space: byte by byte of all, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").reshape(-1)


@dataclass
class Lists:
    """The inverted lists of one block: its phrases, their hashes and those of their last words, how often each occurs, and where, list after list in ascending order. What was not read is None."""

    block: int
    lang: str
    phrases: pa.StringArray | None
    hashes: np.ndarray
    last: np.ndarray | None
    lengths: np.ndarray
    positions: np.ndarray | None

    def batch(self) -> pa.RecordBatch:
        """As a row. Positions are stored as steps from the one before, which are small; words are their own last words."""
        phrases = pa.ListArray.from_arrays(pa.array([0, len(self.phrases)], pa.int32()), self.phrases)
        last = None if self.last is self.hashes else self.last.astype("<u8").tobytes()
        values = [self.hashes.astype("<u8").tobytes(), last, _pack(self.lengths), _pack(np.diff(self.positions, prepend=0))]
        return pa.RecordBatch.from_arrays([pa.array([self.block], pa.int64()), pa.array([self.lang], pa.string()), phrases, *(pa.array([v], pa.binary()) for v in values)], schema=FIELDS)

    def select(self, keep: np.ndarray) -> Lists:
        """The lists of some phrases."""
        (at,) = np.nonzero(keep)
        hashes = self.hashes[at]
        last = hashes if self.last is self.hashes else None if self.last is None else self.last[at]
        return Lists(self.block, self.lang, None if self.phrases is None else self.phrases.take(pa.array(at)), hashes, last, self.lengths[at], None if self.positions is None else self.positions[np.repeat(keep, self.lengths)])

    def longer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, times, positions) of the phrases that are one word longer: each occurrence is merge-joined with the postings of the word behind it.

        Only the last word of a frequent phrase that starts one place later (second) can make a frequent phrase of one (first).
        """
        starts = np.full(int(self.positions.max(initial=0)) + 2, -1, dtype=np.int64)
        starts[self.positions] = np.repeat(np.arange(len(self.lengths)), self.lengths)
        (met,) = np.nonzero((starts[:-1] >= 0) & (starts[1:] >= 0))
        pair = starts[met] * len(self.lengths) + starts[met + 1]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        edge = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        found = pair[edge]
        return found // max(1, len(self.lengths)), found % max(1, len(self.lengths)), np.diff(np.r_[edge, len(pair)]), met[order]


#: Columns of lists that a count of their phrases needs, and one of longer phrases.
COUNT, PLACES = ["lang", "hashes", "lengths"], ["lang", "hashes", "last", "lengths", "positions"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Lists]:
    for batch in batches:
        names = batch.schema.names
        get = lambda name, k: batch.column(names.index(name))[k] if name in names else None  # noqa: B023, E731
        for k in range(batch.num_rows):
            hashes = np.frombuffer(get("hashes", k).as_py(), dtype="<u8")
            phrases, last, positions, block = (get(n, k) for n in ("phrases", "last", "positions", "block"))
            last = None if last is None else hashes if last.as_py() is None else np.frombuffer(last.as_py(), dtype="<u8")
            positions = None if positions is None else np.cumsum(_unpack(positions.as_py()), dtype=np.int64)
            # What earlier blocks took goes back to the system.
            pa.default_memory_pool().release_unused()
            yield Lists(0 if block is None else block.as_py(), get("lang", k).as_py(), None if phrases is None else phrases.values, hashes, last, _unpack(get("lengths", k).as_py()).astype(np.int64), positions)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word, and that word's."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _stored(lists: DataFrame) -> DataFrame:
    path = scratch_path(lists.sparkSession, "lists")
    lists.write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    return lists.sparkSession.read.schema(lists.schema).parquet(path)


def postings(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The inverted lists of all words (LISTS): a row per block, which is texts of one language read by one task.

    A word's position is its place in the block. Pieces are one place apart, so that words follow each other only within a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId() << 33, 0
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal at
            words, parts = held.pop(lang)
            sizes.pop(lang)
            flat = np.concatenate(parts)
            order = np.argsort(flat, kind="stable")
            lengths = np.bincount(flat, minlength=len(words))
            if len(words) > 1:
                seed, own = xxhash.xxh64_intdigest(lang), list(words)[1:]
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in own), dtype=np.uint64, count=len(own))
                yield Lists(number + at, lang, pa.array(own, pa.string()), hashes, hashes, lengths[1:], order[lengths[0] :]).batch()
                at += 1

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                lang = "und" if lang is None else lang
                tokens = (text.as_py() or "").encode().lower().translate(ENDS).replace(b".", b" . ").split()
                if lang not in held:
                    held[lang] = (_Numbers({b".": 0}), [])
                words, parts = held[lang]
                parts.append(np.fromiter(map(words.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
                parts.append(np.zeros(1, dtype=np.int32))
                sizes[lang] = sizes.get(lang, 0) + len(tokens) + 1
                # However many languages there are, a task holds some blocks' worth of words.
                while sizes and (max(sizes.values()) >= block_words or sum(sizes.values()) >= 8 * block_words):
                    yield from flush(max(sizes, key=sizes.__getitem__))
        for lang in list(held):
            yield from flush(lang)

    return docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, LISTS)


class Filter:
    """A Bloom filter of hashes, of at most FILTER_BITS bits whatever it holds: has() may say yes to a phrase that isn't in it, never no to one that is."""

    def __init__(self, found: DataFrame, bits: int):
        """found (key): hashes of `bits` bits."""
        self.mask = np.uint64((1 << bits) - 1)
        n = found.count()
        self.size = max(64, min(FILTER_BITS, 1 << (16 * n).bit_length()))
        places = F.array(F.col("key").bitwiseAND(F.lit(self.size - 1)), F.shiftrightunsigned(F.col("key"), bits // 2).bitwiseAND(F.lit(self.size - 1)))
        words = found.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
        table = words.toArrow()
        self.shift = np.uint64(bits // 2)
        self.words = np.zeros(self.size >> 5, dtype=np.uint32)
        self.words[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        key = hashes & self.mask
        out = np.ones(len(key), dtype=bool)
        for place in (key, key >> self.shift):
            at = place & np.uint64(self.size - 1)
            out &= (self.words[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
        return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


def _packed(part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    data = zstandard.compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([data], pa.binary())], names=["part", "n", "data"])


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1), dtype=np.uint64), raw[8 * n :].astype(np.int64)


def _gathered(lists: DataFrame) -> DataFrame:
    """lists in a quarter of the tasks, where that still fills the cluster twice: what occurs in many blocks is added up in fewer places before it is sent."""
    n = lists.rdd.getNumPartitions()
    least = 2 * lists.sparkSession.sparkContext.defaultParallelism
    return lists.coalesce(max(n // 4, least)) if n > least else lists


def _bits(words: int) -> tuple[int, int]:
    """(bits, low): of a phrase's hash the bits that count, and those of them that don't say which share it belongs to."""
    bits = max(16, (16 * words).bit_length())
    return bits, bits - max(0, (words // SHARE_WORDS).bit_length())


def counted(lists: DataFrame, known: Filter | None, least: int, words: int) -> Filter:
    """A filter of all phrases that occur `least` times or more: those of lists where known is None, else those one word longer that known lets through.

    Phrases are counted by hashes of some 4 bits more than there are words, so that few of different counts meet. A task adds up its blocks; the hashes of a share of
    all go packed to one group, some SHARE_WORDS words' worth however often they occur. Counts stop at 255 a task, as only `least` matters.
    """
    if least > 255:
        raise ValueError("counts are packed up to 255")
    bits, low = _bits(words)
    mask = np.uint64((1 << bits) - 1)
    shared, most = lists.sparkSession.sparkContext.broadcast(known), HELD_COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            edges = np.flatnonzero(np.r_[True, keys[1:] >> np.uint64(low) != keys[:-1] >> np.uint64(low)][: len(keys)]).tolist()
            for a, b in zip(edges, [*edges[1:], len(keys)]):
                yield _packed(int(keys[a] >> np.uint64(low)), keys[a:b] & np.uint64((1 << low) - 1), counts[a:b])

        for block in _read(batches):
            hashes, times = block.hashes, block.lengths
            if shared.value is not None:
                block = block.select(shared.value.has(block.hashes))
                first, second, times, _ = block.longer()
                hashes = mixed(block.hashes[first], block.last[second])
            held.append(_summed(hashes & mask, times))
            if sum(len(k) for k, _ in held) > most:
                held[:] = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                if len(held[0][0]) > most // 2:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    def enough(table: pa.Table) -> pa.Table:
        parts = [_unpacked(n, data) for n, data in zip(table["n"].to_pylist(), table["data"].to_pylist())]
        keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        return pa.table({"key": pa.array((keys[counts >= least] | np.uint64(table["part"][0].as_py() << low)).astype(np.int64))})

    read = _gathered(lists.select(*(COUNT if known is None else PLACES)))
    found = materialize(read.mapInArrow(run, "part long, n long, data binary").groupBy("part").applyInArrow(enough, "key long"), "counted")
    out = Filter(found, bits)
    drop_materialized(found)
    return out


def extended(lists: DataFrame, known: Filter, wanted: Filter) -> DataFrame:
    """lists of phrases one word longer that the filter wanted lets through, of phrases that known does; block by block where the lists are: nothing is shuffled.
    A phrase that is not frequent and passes only makes the lists longer."""
    shared = lists.sparkSession.sparkContext.broadcast((known, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = shared.value
        for block in _read(batches):
            block = block.select(before.has(block.hashes))
            first, second, times, positions = block.longer()
            hashes = mixed(block.hashes[first], block.last[second])
            keep = after.has(hashes)
            if keep.any():
                a, b = first[keep], second[keep]
                behind = pc.replace_substring_regex(block.phrases.take(pa.array(b)), "^.* ", "")
                names = pc.binary_join_element_wise(block.phrases.take(pa.array(a)), behind, " ")
                yield Lists(block.block, block.lang, names, hashes[keep], block.last[b], times[keep], positions[np.repeat(keep, times)]).batch()

    return lists.mapInArrow(run, LISTS)


def frequent(lists: DataFrame, known: Filter, least: int, words: int) -> DataFrame:
    """(lang, phrase, f) of the phrases that lists hold `least` times or more in all blocks of their language. f is the length of the phrase's list; known only spares the others the way.

    A task adds up its blocks and sends the phrases of a share, sorted and packed, to one group, as counted() does with hashes. Phrases are compared by their texts.
    """
    bits, low = _bits(words)
    shared, most = lists.sparkSession.sparkContext.broadcast(known), HELD_COUNTS
    keys = ["lang", "phrase"]

    def total(tables: list[pa.Table], extra: list[str]) -> pa.Table:
        return pa.concat_tables(tables).group_by([*extra, *keys]).aggregate([("n", "sum")]).rename_columns([*extra, *keys, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = total(held, ["part"]).sort_by([("part", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])
            parts = table["part"].to_numpy()
            edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]][: len(parts)]).tolist()
            for a, b in zip(edges, [*edges[1:], len(parts)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.drop_columns("part").schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.drop_columns("part").slice(a, b - a).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([int(parts[a])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "data"])

        for block in _read(batches):
            block = block.select(shared.value.has(block.hashes))
            part = ((block.hashes & np.uint64((1 << bits) - 1)) >> np.uint64(low)).astype(np.int64)
            held.append(pa.table({"part": pa.array(part), "lang": pa.array([block.lang] * len(part), pa.string()), "phrase": block.phrases, "n": pa.array(block.lengths)}))
            if sum(len(t) for t in held) > most:
                held[:] = [total(held, ["part"])]
                if len(held[0]) > most // 2:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    def enough(table: pa.Table) -> pa.Table:
        every = total([pa.ipc.open_stream(d.as_py()).read_all() for d in table["data"]], [])
        found = every.filter(pc.greater_equal(every["n"], least)).rename_columns([*keys, "f"])
        return found.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))

    read = _gathered(lists.select(*COUNT, "phrases"))
    return read.mapInArrow(run, "part long, data binary").groupBy("part").applyInArrow(enough, "lang string, phrase string, f long")


#: floor(2000000 * a / (l + r)); decimals, as the product may pass 64 bits.
SCORE = "(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, inside: tuple[int, int] = (80, 100), block_words: int = BLOCK_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first `most` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    1. Texts are cut at punctuation and line ends into pieces and those at blanks into words, with A-Z in lower case. Each block of texts keeps the
       ascending positions of every word.
    2. Frequent phrases are extended by a word at a time: in each block their positions are merge-joined with the postings of the words one place on. The
       length of a list over all blocks is the phrase's exact frequency; only phrases of `least` occurrences go on. Lists stay where they are: tasks know which
       phrases to go on with by a filter of bounded size, made from counts of hashes. What it lets through by mistake costs time and changes nothing.
    3. A candidate of frequency a is cut in two parts of frequencies l and r where floor(2000000 a / (l + r)) is least, at the first such cut. Candidates whose words
       lie within a longer one that occurs inside[0] of inside[1] times as often or more are dropped.

    n is the number of words of the language. A null text is empty, a null language is und; languages without a candidate give no row, nor does an empty table. Ties
    of score go by a, then by the phrase's bytes. Repeated rows count each. A very long text is in one block, whole. Other columns are not read.
    """
    with batches_of(docs.sparkSession, BATCH_BYTES):
        return _collocations(docs, least, longest, most, inside, block_words, text_col, lang_col)


def _collocations(docs: DataFrame, least: int, longest: int, most: int, inside: tuple[int, int], block_words: int, text_col: str, lang_col: str) -> DataFrame:
    lists = _stored(postings(docs, text_col, lang_col, block_words))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(_unpack(x.as_py()).sum()) for x in batch.column(1)], pa.int64())], names=["lang", "n"])

    shares = lists.select("lang", "lengths").mapInArrow(sizes, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    totals = materialize(shares, "totals")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    levels, passing = [], counted(lists, None, least, words)
    for k in range(1, longest + 1):
        levels.append(materialize(frequent(lists, passing, least, words).withColumn("words", F.lit(k)), "frequent"))
        if k < longest:
            wanted = counted(lists, passing, least, words)
            longer = extended(lists, passing, wanted)
            if k + 1 < longest:  # the lists of the longest phrases are only counted
                longer = _stored(longer)
                drop_materialized(lists)
            lists, passing = longer, wanted
    drop_materialized(lists)
    known = materialize(reduce(DataFrame.unionByName, levels), "phrases")
    for level in levels:
        drop_materialized(level)

    candidates = known.where("words > 1")
    parts = F.split("phrase", " ")
    some = lambda first, size: F.array_join(F.slice(parts, first, size), " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", some(F.lit(1), F.col("k")).alias("left"), some(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    best = F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(best.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: some(at, size))))
    within = candidates.where("words > 2").select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * inside[1] < F.col("a").cast("decimal(38,0)") * inside[0]))

    # Each language's first ones among shares of its candidates, then among those.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = kept.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    share = share.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_at") <= most)
    first = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    out = materialize(first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop_materialized(known)
    drop_materialized(totals)
    return out


def op12_phrase_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS words FROM p),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i : i + k - 1], ' '))) AS phrase
  FROM w JOIN sizes ON len(words) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1 : j], ' ') AS lp, array_to_string(ws[j + 1 : k], ' ') AS rp FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
s AS (
  SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
spans AS (
  SELECT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase
  FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k),
longer AS (SELECT lang, phrase, max(a) AS f FROM spans GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase WHERE longer.f IS NULL OR 100 * longer.f < 80 * best.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

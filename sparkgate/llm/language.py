"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgate.session import materialize

SPACE = 32
#: Distinct n-grams that a task holds while it counts, and the largest table of filters that is sent to the executors, in bytes.
HELD, MOST_BYTES = 1 << 21, 1 << 28


@cache
def _letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(texts: list[str | None], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, row of each, which rows have a letter) for the n-grams of lower-cased words with a blank at both ends.

    A gram is the mix of its code points, 21 bits each: of at most three, so that no two n-grams share a number.
    """
    joined = " ".join(["", *[(t or "").lower().replace("\0", " ") + " \0" for t in texts], ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    rows = np.cumsum(codes == 0, dtype=np.int32)
    letter = _letters()[codes]
    has = np.bincount(rows[letter], minlength=len(texts))[: len(texts)] > 0
    x = np.where(letter, codes, SPACE).astype(np.uint64)
    found, where = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)]
    for n in orders:
        if len(x) < n:
            continue
        h = np.zeros(len(x) - n + 1, dtype=np.uint64)
        inner = np.ones(len(h), dtype=bool)
        some = np.zeros(len(h), dtype=bool)
        for k in range(n):
            part = slice(k, len(x) - n + 1 + k)
            h |= x[part] << np.uint64(21 * k)
            some |= letter[part]
            if 0 < k < n - 1:
                inner &= letter[part]
        use = inner & some
        found.append(_mix(h[use]))
        where.append(rows[: len(h)][use])
    return np.concatenate(found), np.concatenate(where), has


def runs(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """[start, end) of rows of about `most` characters together, so that a batch of long texts doesn't fill a task's memory; a longer text is a run of its own."""
    start = held = 0
    for k, t in enumerate(texts):
        if k > start and held + len(t or "") > most:
            yield start, k
            start, held = k, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Model:
    """languages in order; table[w, p] holds the bits of languages 64 * w to 64 * w + 63 at filter position p; fill is the share of set bits per language."""

    languages: tuple[str, ...]
    table: np.ndarray
    fill: np.ndarray
    hashes: int
    orders: tuple[int, ...]


def width_of(size: int, hashes: int) -> int:
    """Bits of a gram that make one position; grams are well mixed, so each position takes bits of its own."""
    width = size.bit_length() - 1
    if size != 1 << width or width * hashes > 64:
        raise ValueError("filters have a power of two of positions, and all positions of a gram come from its 64 bits")
    return width


def positions(found: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    width = width_of(size, hashes)
    return [((found >> np.uint64(width * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(hashes)]


def _added(u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of u, with the sums of n."""
    order = np.argsort(u, kind="stable")
    u, n = u[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, dtype=np.int64)
    return u[first], np.add.reduceat(n, first) if len(u) else n


def _counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(found)
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, dtype=np.int64)
    return found[first], np.diff(np.concatenate([first, [len(found)]])).astype(np.int64)


def count_grams(docs: DataFrame, orders: tuple[int, ...], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all docs with a lang.

    A task adds up the n-grams of its texts, about a million characters at a time, and sends what it has when that is more than HELD
    distinct ones of all languages: bounded, however many languages and n-grams there are. Spark adds up the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = after = 0

        def merge() -> int:
            for lang, parts in held.items():
                if len(parts) > 1:
                    held[lang] = [_added(*map(np.concatenate, zip(*parts)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                u, n = parts[0]
                for k in range(0, len(u), 50_000):
                    some = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u[some]), pa.string()), pa.array(u[some].view(np.int64)), pa.array(n[some])], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for start, end in runs(texts):
                    part = _counted(grams(texts[start:end], orders)[0])
                    held.setdefault(lang, []).append(part)
                    size += len(part[0])
                    if size > max(HELD // 4, 2 * after):
                        size = after = merge()
                        if after > HELD:
                            yield from out()
                            size = after = 0
        merge()
        yield from out()

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, orders: tuple[int, ...] = (2, 3), least_share: float = 2e-5, rival: float = 0.25, filter_bits: int = 1 << 20, hashes: int = 3, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Filters of all languages in docs, from all rows that have a language and a text.

    An n-gram belongs to a language if its share among the language's n-grams is at least least_share and at least `rival` times
    its share in any language. The filters are filled on the executors: each n-gram sets the bit of its languages at `hashes` positions, and a
    bitwise or adds them up. What reaches the driver is the table of filters, filter_bits rows for each 64 languages at most, and
    the list of languages.
    """
    if max(orders) > 3:
        raise ValueError("n-grams have at most three code points")
    width = width_of(filter_bits, hashes)
    counts = materialize(count_grams(docs, orders, text_col, lang_col), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(totals, "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= least_share)
    best = share.groupBy("gram").agg(F.max("share").alias("best"))
    member = materialize(share.join(best, "gram").where(F.col("share") >= rival * F.col("best")).select("lang", "gram"), "members")
    languages = tuple(sorted(r["lang"] for r in member.select("lang").distinct().collect()))
    words = (len(languages) + 63) // 64
    if words * filter_bits * 8 > MOST_BYTES:
        raise ValueError(f"filters of {len(languages)} languages are larger than {MOST_BYTES} bytes: take fewer filter_bits")
    code = docs.sparkSession.createDataFrame(list(enumerate(languages)), "k int, lang string")
    at = F.explode(F.array(*[F.shiftrightunsigned("gram", width * i).bitwiseAND(F.lit(filter_bits - 1).cast("long")) for i in range(hashes)]))
    bit = F.expr("shiftleft(1L, k % 64)")
    slices = member.join(code, "lang").select(F.floor(F.col("k") / 64).alias("w"), at.alias("p"), bit.alias("bit")).groupBy("w", "p").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros((words, filter_bits), dtype=np.uint64)
    found = slices.toArrow()
    table[found["w"].to_numpy(), found["p"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    fill = np.array([((table[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Model(languages, table, fill, hashes, orders)


def popcounts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hits [languages, texts], n-grams per text, which texts have a letter): an n-gram hits every language whose bit is set at all its positions."""
    found, rows, has = grams(texts, model.orders)
    n = np.bincount(rows, minlength=len(texts))[: len(texts)]
    at = positions(found, model.table.shape[1], model.hashes)
    hits = np.zeros((len(model.languages), len(texts)), dtype=np.int64)
    for w in range(len(model.table)):
        held = np.bitwise_and.reduce([model.table[w, p] for p in at])
        for k in range(64 * w, min(64 * w + 64, len(model.languages))):
            own = rows[(held >> np.uint64(k % 64)) & np.uint64(1) == 1]
            hits[k] = np.bincount(own, minlength=len(texts))[: len(texts)]
    return hits, n, has


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text: hits per language, less what false positives give, over the n-grams of the text."""
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    hits, n, has = popcounts(model, texts)
    fp = (model.fill**model.hashes)[:, None]
    corrected = np.maximum(0.0, (hits - fp * n) / np.maximum(1.0 - fp, 1e-9))
    best = corrected.argmax(axis=0)
    score = np.where(has & (n > 0), np.minimum(1.0, corrected[best, np.arange(len(texts))] / np.maximum(n, 1)), 0.0)
    return [model.languages[b] if h else "und" for b, h in zip(best, has)], score.tolist()


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1), from the text alone.

    A text that is null or has no letter is `und` with score 0; so is every text if the model knows no language. Ties go to the first language by code point. One
    row per input row; columns of these names are replaced. An empty table gives an empty result. Narrow: no shuffle; the model is broadcast, and
    learn() bounds its size by MOST_BYTES.
    """
    held = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = held.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            parts = [decide(shared.value, texts[start:end]) for start, end in runs(texts)]
            lang, score = ([x for p in parts for x in p[k]] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = held.select("*", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return held.mapInArrow(run, schema)


def op10_bloom_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")

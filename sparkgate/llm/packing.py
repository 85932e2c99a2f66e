"""Hierarchical packing of tokenized documents into windows of several lengths."""

from __future__ import annotations

import bisect
import json
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
#: Pieces that share a drain of the pools: bounds what a task holds, in tokens.
POOL_TOKENS = 1 << 19
#: Distinct parts of texts between blanks that a worker remembers, some 100 MB of them, and the most characters that are cut by the tokenizer's own pattern at once.
MEMORY, SHORT = 400_000, 256
#: Texts on which the cached path must give the library's own ids before it is used.
PROBES = ("", "Hello, world! It's 12345 o'clock.", "  two  blanks \n\n\tand\ttabs \r\n", "naïve Straße Ελληνικά Привет 日本語 한국어 العربية", "😀👩‍👩‍👧 e\u0301 \u00a0\u200b", "def f(x):\n    return x['a'] + 0x1F  # ünï", "A" * 70 + "aaaa" * 30, "don't WE'LL I'VE 3rd 1,000.50 ---==== <|x|>", "\x00\x7f\x1b")


class Known(dict):
    """What `make` gives for each short text, as bytes of ids, remembered for the first MEMORY of them: what comes early is what comes often."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        got = self.make(text)
        if len(text) <= 40 and len(self) < MEMORY:
            self[text] = got
        return got


@cache
def cached_path_holds(path: str | None) -> bool:
    """Does the cached path give the library's own ids on PROBES? Asked once, before tasks start, so that workers don't hold the library's tokenizer beside it."""
    whole, encode = library(path), encoder(path, True)
    try:
        return encode is not None and all(np.array_equal(encode(t), whole(t)) for t in PROBES)
    except BaseException:  # ids that are no ranks make the cached path panic
        return False


def library(path: str | None) -> Callable[[str], np.ndarray]:
    """ids of a text by the tokenizer file, by the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
    return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")


@cache
def encoder(path: str | None, cached: bool) -> Callable[[str], np.ndarray] | None:
    """ids of a text by the tokenizer file: by a cached path for byte-level BPE files, None for others; or by the library.

    path None is the public 50k byte-level vocabulary of the installed tokenizer files.
    """
    import public_tokenizers
    import regex
    import tiktoken

    if not cached:
        return library(path)
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        spec = json.load(f)
    if not (spec["model"].get("type") == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")):
        return None
    # Byte-level vocabularies write bytes as printable characters; ids of such a vocabulary are its merge ranks.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocabulary = {token: k for token, k in spec["model"]["vocab"].items() if token not in special}
    if any(c not in letter for token in vocabulary for c in token):
        return None
    ranks = {bytes(letter[c] for c in token): k for token, k in vocabulary.items()}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # This pattern takes a pre-token whole, as it comes from the split below.
    pieces = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    split = regex.compile(public_tokenizers.PATTERN).findall
    marks = regex.compile("|".join(map(regex.escape, special))) if special else None
    white, cut = regex.compile(r"[\s\x1c-\x1f] "), regex.compile(r"(?<![\s\x1c-\x1f]) ")

    def plain(text: str) -> list[int]:
        # On long runs of white characters the first one's pattern would give up.
        return whole.encode_ordinary(text) if len(text) <= SHORT else [x for token in split(text) for x in pieces.encode_ordinary(token)]

    packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    spaced = Known(lambda part: packed(plain(" " + part)))

    def ids(text: str) -> bytes:
        # A pre-token holds no blank behind its first character unless it is white all through: one starts at every blank behind what is not white. Texts are cut there, and what lies between
        # such blanks is looked up whole; a run of white characters stays in one part.
        first, *rest = cut.split(text) if white.search(text) else text.split(" ")
        return packed(plain(first)) + b"".join(map(spaced.__getitem__, rest))

    def encode(text: str) -> np.ndarray:
        out, at = [], 0
        for m in marks.finditer(text) if marks else ():
            out += [ids(text[at : m.start()]), packed([special[m[0]]])]
            at = m.end()
        return np.frombuffer(b"".join([*out, ids(text[at:] if at else text)]), dtype="<u4")

    return encode


class Packer:
    """Packs the pieces of one partition. Deterministic in the order of its input.

    Whole windows of long documents leave at once. What is left of a document waits in a pool with its tier, the smallest
    window that holds it. A drain packs tier by tier from the longest: each window starts with the tier's longest piece, its gap is
    filled by the longest waiting piece that fits, then by a cut of the shortest that does not.
    """

    def __init__(self, tiers: tuple[int, ...], least_cut: int, step_tokens: int):
        self.tiers, self.least_cut, self.step_tokens = sorted(tiers), least_cut, step_tokens
        self.lengths: list[int] = []  # of the waiting pieces, ascending, beside them
        self.waiting: list[tuple] = []
        self.held = self.sequence = self.emitted = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at, size = 0, sum(len(p[2]) for p in pieces)
        window = size if size in self.tiers else self.tiers[-1]
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids.tobytes(), len(ids), total, self.sequence, at, window, self.emitted // self.step_tokens))
            at += len(ids)
        self.sequence += 1
        self.emitted += window

    def _wait(self, piece: tuple) -> None:
        k = bisect.bisect_left(self.lengths, len(piece[2]))
        self.lengths.insert(k, len(piece[2]))
        self.waiting.insert(k, piece)
        self.held += len(piece[2])

    def _take(self, k: int) -> tuple:
        self.held -= self.lengths.pop(k)
        return self.waiting.pop(k)

    def _cut(self, piece: tuple, n: int) -> tuple:
        doc, start, ids, total = piece
        self._wait((doc, start + n, ids[n:], total))
        return (doc, start, ids[:n], total)

    def add(self, doc, ids: np.ndarray) -> None:
        top, at = self.tiers[-1], 0
        while len(ids) - at >= top:
            self._emit([(doc, at, ids[at : at + top], len(ids))])
            at += top
        if at < len(ids):
            self._wait((doc, at, ids[at:].copy(), len(ids)))
        if self.held >= POOL_TOKENS:
            self.drain(False)

    def drain(self, last: bool) -> None:
        """Windows of every tier while they can be filled; with `last`, everything."""
        for k in range(len(self.tiers) - 1, -1, -1):
            window, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.lengths and self.lengths[-1] > below and self.held >= window:
                self._fill(window)
        if last:
            while self.lengths:
                # Too little for a window of the piece's own tier: the largest window that can be filled, else one padded window.
                window = max((t for t in self.tiers if t <= self.held), default=self.tiers[-1])
                self._fill(window)

    def _fill(self, window: int) -> None:
        pieces, gap = [], window
        while gap and self.lengths:
            k = bisect.bisect_right(self.lengths, gap)
            if k:
                pieces.append(self._take(k - 1))
            elif gap >= self.least_cut or window < self.tiers[-1]:  # a shorter window that is not full would be padded to the longest
                pieces.append(self._cut(self._take(0), gap))
            else:
                break
            gap -= len(pieces[-1][2])
        self._emit(pieces)


def pack(docs: DataFrame, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int | None = 1, least_cut: int = 8, step_tokens: int = 1 << 17, tokenizer_path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of all documents packed into windows of the given lengths (powers of two, longest last).

    Per piece: doc_id, start (the document's ids before it), length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset (in
    the sequence, gapless), context (the window's length) and step_group (sequences of step_tokens window tokens, give or take one
    window, so that the groups of a partition weigh the same but for its last one).

    A document is its ids plus end_id (None: no end). A null text is empty; with no end_id an empty document has no piece. Ids of documents may be
    null or repeat: each row is packed for itself. Very long texts are cut into whole windows as they come. An empty table gives an
    empty result. Each task packs its own input partition, with POOL_TOKENS tokens waiting at most: no shuffle, and one padded
    window per partition. Other columns of docs are not carried.
    """
    schema = "doc_id long, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long, context int, step_group long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    cached = cached_path_holds(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path, cached), Packer(tiers, least_cut, step_tokens)
        base = TaskContext.get().partitionId() << 33
        end = np.array([] if end_id is None else [end_id], dtype="<u4")

        def out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*packer.rows)] or [[] for _ in names]
            columns[5] = [base + x for x in columns[5]]
            columns[8] = [base + x for x in columns[8]]
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.concatenate([encode(text.as_py() or ""), end]))
                if len(packer.rows) >= 4096:
                    yield out()
        packer.drain(True)
        yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op7_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")

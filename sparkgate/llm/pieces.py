"""SentencePiece encoding by vectorised merge rounds over flat symbol arrays, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: No pair of symbols: larger than every rank.
NONE = np.iinfo(np.int32).max
#: The table of pairs: slots, and an odd multiplier whose upper bits choose one.
SLOT_BITS, MIX = 19, np.uint64(0x9E3779B97F4A7C15)
#: Of a segment with more occurrences than this that can't be merged at once, all are merged in turn in one round, else the first.
IN_TURN = 6
#: Words that a worker remembers (and those of the texts then encoded), and the characters of texts that are encoded together.
MEMORY, TOGETHER = 200_000, 1 << 20


class Pieces:
    """A SentencePiece BPE model with byte fallback as arrays, and encoding with them.

    Symbols are numbered: first the ids of the vocabulary, then the characters that occur in pieces but are none themselves. A pair of
    symbols that makes a piece has the rank of that piece's score, 0 for the best.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = {int(sp.id_to_piece(k)[3:-1], 16): k for k in range(n) if sp.is_byte(k)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        special = [sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) for k in range(n)]
        if any(sp.is_unused(k) for k in range(n)):
            raise ValueError("the model has unused pieces")
        texts = {k: sp.id_to_piece(k) for k in range(n) if not special[k]}
        scores = {k: sp.get_score(k) for k in texts}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {k: order[s] for k, s in scores.items()}

        symbol = {t: k for k, t in texts.items()}
        for c in sorted(set("".join(texts.values()))):
            symbol.setdefault(c, len(symbol) + sum(special))
        self.count = n
        self.symbols = np.int64(len(symbol) + sum(special))
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for t, k in symbol.items():
            if len(t) == 1:
                self.of_char[ord(t)] = k

        pairs = {}
        alone = np.bincount(list(rank.values()), minlength=len(order)) == 1
        # A rank is safe if no pair that its piece may become part of comes before it: then all its pairs can be merged at once.
        safe = alone.copy()
        for k, t in texts.items():
            for cut in range(1, len(t)):
                left, right = symbol.get(t[:cut]), symbol.get(t[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.symbols) + right] = k
                for part in (left, right):
                    if part in rank and rank[part] >= rank[k]:
                        safe[rank[part]] = False
        self.pairs = {k: (rank[p], p) for k, p in pairs.items()}
        # Keys in order of their slots: place 0 stands for no pair, and what follows the last slot belongs to none.
        keys = np.array(list(pairs) or [-1], dtype=np.int64)
        slot = (keys.view(np.uint64) * MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.deepest = int(np.bincount(slot).max())
        self.keys = np.concatenate([[-1], keys[order], [-1] * self.deepest])
        self.slots = (np.searchsorted(slot[order], np.arange(1 << SLOT_BITS)) + 1).astype(np.int32)
        made = [self.pairs.get(k, (NONE, -1)) for k in self.keys.tolist()]
        self.ranks, self.results = (np.array([m[c] for m in made], dtype=np.int32) for c in (0, 1))
        self.safe = safe

        # Characters next to each other in no piece are never merged: words are cut there.
        inner = {ord(a) << 21 | ord(b) for t in texts.values() for a, b in zip(t, t[1:])}
        self.neighbours = np.array(sorted(inner), dtype=np.int64)
        cuts_at_spaces = not any(a != SPACE and b == SPACE for t in texts.values() for a, b in zip(t, t[1:]))
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if cuts_at_spaces else r"(?s:.+)").findall
        # Words that were encoded before: their numbers, their ids one after the other, and where those end.
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

        # For decoding: the bytes of each id one after the other; those of control and unknown ids are not plain.
        self.plain = np.array([not (sp.is_control(k) or sp.is_unknown(k)) for k in range(n)])
        shown = [texts[k].replace(SPACE, " ").encode() if k in texts else b"" for k in range(n)]
        for value, k in self.byte_ids.items():
            shown[k] = bytes([value])
        self.text = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.text_size = np.array([len(x) for x in shown], dtype=np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        # Does decoding take away the space that encoding puts before the text?
        self.strips = sp.decode([symbol[SPACE]]) == "" if SPACE in symbol and symbol[SPACE] < n else None

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of symbols; NONE where they make no piece. A pair's key is among the few of its slot."""
        key = left * self.symbols + right
        slot = (key.view(np.uint64) * MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place = self.slots[slot]
        found = np.zeros(len(key), dtype=np.int32)
        for k in range(self.deepest):
            at = place + k
            np.copyto(found, at, where=self.keys[at] == key)
        return self.ranks[found], self.results[found]

    def _in_turn(self, symbols: np.ndarray, rank: int, hits: np.ndarray, low: int, high: int, alive: np.ndarray, dirty: np.ndarray) -> None:
        """Merges the hits of one segment [low, high) from left to right, each followed by what it makes that comes no later than rank."""
        ahead = {}  # the next living symbol, where it isn't the next one
        behind = {}
        table, width, none = self.pairs, int(self.symbols), (NONE, -1)

        def get(a: int, b: int) -> tuple[int, int]:
            left, right = int(symbols[a]), int(symbols[b])
            return none if left < 0 or right < 0 else table.get(left * width + right, none)

        for at in hits.tolist():
            other = ahead.get(at, at + 1)
            if not alive[at] or other >= high or get(at, other)[0] != rank:
                continue
            while True:
                _, symbols[at] = get(at, other)
                alive[other], dirty[at] = False, True
                after = ahead.get(other, other + 1)
                ahead[at] = after
                behind[after] = at
                before = behind.get(at, at - 1)
                if before >= low:
                    dirty[before] = True
                options = [(get(before, at)[0], before, at)] if before >= low else []
                options += [(get(at, after)[0], at, after)] if after < high else []
                best = min(options, default=(NONE, 0, 0))
                if best[0] > rank:
                    break
                _, at, other = best

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, start, codes): the symbols of all words after all merges, in order, with the place of their first character in codes.

        Every round takes the least rank of each segment that still has a pair. All its occurrences are merged at once, from the left where they overlap;
        where a merge may make a pair that comes before the other occurrences, only the leftmost is, or many are in turn. Then the arrays are compacted.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        if not len(codes):
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), codes
        ends = np.cumsum([len(w) for w in words])
        cut = np.zeros(len(codes), dtype=bool)
        cut[ends[ends < len(codes)]] = True
        both = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.neighbours, both), max(0, len(self.neighbours) - 1))
        cut[1:] |= self.neighbours[at] != both if len(self.neighbours) else True
        segment = np.cumsum(cut, dtype=np.int32)
        start, symbol = np.arange(len(codes), dtype=np.int32), self.of_char[codes]

        def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            after = np.minimum(at + 1, len(symbol) - 1)
            left, right = symbol[at].astype(np.int64), symbol[after].astype(np.int64)
            apart = (left < 0) | (right < 0) | (after == at) | (segment[at] != segment[after])
            rank, piece = self._look(left, right)
            rank[apart] = NONE
            return rank, piece

        rank, piece = pairs(start)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            size = np.diff(np.r_[first, len(symbol)])
            least = np.minimum.reduceat(rank, first)
            ready = least == NONE
            if ready.any():
                over = np.repeat(ready, size)
                done.append((symbol[over], start[over]))
                left = np.flatnonzero(~over)
                symbol, start, segment, rank, piece = (x.take(left) for x in (symbol, start, segment, rank, piece))
                size, least = size[~ready], least[~ready]
                if not len(symbol):
                    break
            (hits,) = np.nonzero(rank == np.repeat(least, size))
            group = np.repeat(np.arange(len(size), dtype=np.int32), size)[hits]
            alive, dirty = np.ones(len(symbol), dtype=bool), np.zeros(len(symbol), dtype=bool)
            if len(hits) > len(size):
                times = np.bincount(group, minlength=len(size))
                turn = (times > IN_TURN) & ~self.safe[least]
                ends = np.cumsum(size)
                for g in np.flatnonzero(turn).tolist():
                    self._in_turn(symbol, int(least[g]), hits[group == g], int(ends[g] - size[g]), int(ends[g]), alive, dirty)
                keep = ~turn[group] & (self.safe[least][group] | np.r_[True, group[1:] != group[:-1]])
                hits = hits[keep]
                # Of overlapping pairs of equal symbols every second one is merged, from the left.
                runs = np.r_[True, hits[1:] != hits[:-1] + 1][: len(hits)]
                within = hits - hits[runs][np.cumsum(runs) - 1]
                hits = hits[within % 2 == 0]
            symbol[hits] = piece[hits]
            alive[hits + 1] = False
            dirty[hits] = True
            dirty[np.maximum(hits - 1, 0)] = True
            left = np.flatnonzero(alive)
            symbol, start, segment, rank, piece, dirty = (x.take(left) for x in (symbol, start, segment, rank, piece, dirty))
            again = np.flatnonzero(dirty)
            rank[again], piece[again] = pairs(again)
        symbols, starts = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(starts)
        return symbols[order], starts[order], codes

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of all words of normalized text, one after the other. Characters without a piece are the ids of their bytes."""
        symbols, starts, codes = self.merged(words)
        ends = np.searchsorted(starts, np.cumsum([len(w) for w in words], dtype=np.int64))
        (bare,) = np.nonzero((symbols < 0) | (symbols >= self.count))
        if not len(bare):
            return symbols, ends
        raw = [[self.byte_ids[b] for b in chr(c).encode("utf-8", "replace")] for c in codes[starts[bare]].tolist()]
        times = np.ones(len(symbols), dtype=np.int64)
        times[bare] = [len(r) for r in raw]
        after = np.cumsum(times)
        ids = np.repeat(symbols, times)
        ids[np.repeat(np.isin(np.arange(len(symbols)), bare, assume_unique=True), times)] = list(chain.from_iterable(raw))
        return ids, np.where(ends > 0, after[ends - 1], 0)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts one after the other, as the library's encode() gives them."""
        split = [self.words(self.library.normalize(t)) if t else [] for t in texts]
        every = list(chain.from_iterable(split))
        number = np.fromiter(map(self.known.get, every, repeat(-1)), dtype=np.int64, count=len(every))
        flat, ends = self.flat, self.ends
        (missing,) = np.nonzero(number < 0)
        if len(missing):
            fresh: dict[str, int] = {}
            number[missing] = [fresh.setdefault(every[k], len(ends) + len(fresh)) for k in missing.tolist()]
            new, new_ends = self.encode_words(list(fresh))
            flat, ends = np.concatenate([flat, new]), np.concatenate([ends, new_ends + len(flat)])
            if len(self.known) < MEMORY:  # what comes early is what comes often
                self.known.update(fresh)
                self.flat, self.ends = flat, ends
        sizes = np.diff(ends, prepend=0)
        length = sizes[number]
        before = np.cumsum([0, *(len(w) for w in split)])
        offsets = np.concatenate([[0], np.cumsum(length)])[before]
        return _gather(flat, (ends - sizes)[number], length), offsets

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text."""
        ids, offsets = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(offsets, offsets[1:])]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids, as the library's decode() gives it. Control and unknown ids and broken bytes are the library's own affair."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        if self.strips is None or ids.min() < 0 or ids.max() >= self.count or not self.plain[ids].all():
            return self.library.decode(ids.tolist())
        try:
            text = _gather(self.text, self.text_at[ids], self.text_size[ids]).tobytes().decode()
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist())
        return text[1:] if self.strips and text[:1] == " " and ids[0] != self.byte_ids[32] else text


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


@cache
def pieces(path: str | None = None) -> Pieces:
    """The model at path, None for the public 32k vocabulary of the installed tokenizer files."""
    import public_tokenizers

    return Pieces(path or public_tokenizers.path(MODEL))


@cache
def checked(path: str | None) -> bool:
    """Every piece of the vocabulary, encoded by merge rounds, must give the library's ids; a model of another kind than BPE doesn't."""
    model = pieces(path)
    texts = [model.library.id_to_piece(k).replace(SPACE, " ") for k in range(model.count)]
    if any(a.tolist() != b for a, b in zip(model.encode(texts), model.library.encode(texts))):
        raise ValueError("the model is no BPE model that merge rounds can encode")
    return True


def tokenized(docs: DataFrame, model_path: str | None = None, decoded: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) per row of docs: the ids of its whole text, and the text of those ids.

    ids are those of the library's encode() without begin and end ids and without sampling. A text is normalized, cut into words where no piece
    crosses, and the words of many texts that are new to a task are encoded together by merge rounds. A null or empty text has no ids and decodes to
    nothing. Rows stay as they are: ids may be null or repeat, equal texts give equal ids. A very long text is one row; its words are
    encoded with each other. An empty table gives an empty result. Other columns of docs are not carried. Models must be BPE with byte fallback (checked).
    No shuffle; a task holds one Arrow batch, TOGETHER characters or one text of work, and MEMORY words at most.
    """
    checked(model_path)
    names, fields = ["doc_id", "ids", "decoded"], [pa.int64(), pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held = [], 0
                while at + len(texts) < batch.num_rows and (held < TOGETHER or not texts):
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    held += len(texts[-1])
                ids, offsets = model.encode_flat(texts)
                flat = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                back = pa.array([model.decode(ids[a:b]) if decoded else None for a, b in zip(offsets, offsets[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), flat, back], schema=pa.schema(list(zip(names, fields))))
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op11_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), joined.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

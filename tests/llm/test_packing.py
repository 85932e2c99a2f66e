import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkgate.llm.packing import TOKENIZER, Packer, cached_path_holds, encoder, op7_tiered_packing, pack

TIERS = (256, 512, 1024, 2048)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def test_ids_are_those_of_the_tokenizer(spark, whole):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["", " ", "a  b\n\n c\t", "it's we'll 12 345 日本語 😀 é x", "a<|endoftext|>b<|endoftext|>", "x" * 500, "\x00\x7f"]
    for t, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert encoder(None, True)(t).tolist() == e.ids
    assert cached_path_holds(None)


def check(rows, docs, most=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, ids in docs.items():
        at = 0
        for r in sorted(by_doc.pop(d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    padded = used = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= most
        used += at
        padded += 0 if at & (at - 1) == 0 else most - at
    return padded, used


def test_query_packs_every_id_once(spark, whole):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: whole.encode(r.text or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    padded, used = check(op7_tiered_packing(spark, sf).collect(), docs)
    assert padded <= 0.02 * used


def test_nulls_repeats_and_long_texts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "word " * 60_000, 1), (4, "a", 1), (4, "a", 1)], "doc_id long, text string, length int").coalesce(1)
    rows = pack(docs).select("*", F.crc32("ids").alias("ids_crc32")).collect()
    assert sorted(r.doc_tokens for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert sum(r.length for r in rows if r.doc_id == 4) == 4 and sum(r.length for r in rows if r.doc_id is None) == 3
    assert sum(r.length for r in rows if r.doc_id == 3) == rows[0].doc_tokens
    assert pack(docs.limit(0)).count() == 0


def test_tiers_fill_gaps_and_groups_balance():
    rng = np.random.default_rng(1)
    packer = Packer(TIERS, 8, 1 << 14)
    total = 0
    for d in range(3000):
        n = int(rng.integers(1, 5000))
        total += n
        packer.add(d, np.arange(n, dtype="<u4"))
    packer.drain(True)
    sizes, contexts, groups = defaultdict(int), {}, defaultdict(int)
    for doc, start, ids, n, tot, seq, off, context, group in packer.rows:
        sizes[seq] += n
        contexts[seq] = context
    assert sum(sizes.values()) == total
    assert sum(contexts[s] - n for s, n in sizes.items()) <= 0.01 * total
    for r in packer.rows:
        groups[r[8]] |= 0
    weight = defaultdict(int)
    group_of = {r[5]: r[8] for r in packer.rows}
    for s, g in group_of.items():
        weight[g] += contexts[s]
    whole = [w for g, w in weight.items() if g != max(weight)]
    assert max(whole) - min(whole) <= 2 * 2048


def test_ids_that_are_no_ranks_come_from_the_library(tmp_path):
    import json

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    top = max(vocab.values())
    spec["model"]["vocab"] = {t: (k if k < 300 else top + 300 - k) for t, k in vocab.items()}
    path = tmp_path / "turned.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    text = "Hello there, naïve world 123 😀"
    want = Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert not cached_path_holds(str(path)) and encoder(str(path), False)(text).tolist() == want != encoder(None, True)(text).tolist()
    other = public_tokenizers.path("word_bpe_49k.json")
    assert not cached_path_holds(other) and encoder(other, False)(text).tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


def test_parts_between_blanks_give_the_librarys_ids(whole, monkeypatch):
    from sparkgate.llm import packing

    rng = np.random.default_rng(5)
    pool = [" ", " ", "  ", "\n", "\t", "\x1c", "\x1f", "​", "\x85", "　", "\r\n", "a", "Bc", "'s", "'", "don't", "12", "é", "日本", ".", "...", ",", "_", " a", " 1", "<|endoftext|>", "<|x|>"]
    texts = ["".join(rng.choice(pool, int(rng.integers(0, 14)))) for _ in range(2000)] + [" " * 100_000, "a" + " \n" * 50_000, "\n" * 1000 + " b"]
    encode = encoder.__wrapped__(None, True)
    assert all(encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)
    monkeypatch.setattr(packing, "MEMORY", 2)
    made = []
    known = packing.Known(lambda t: made.append(t) or t.encode())
    assert [known[t] for t in "abcabc"] == [t.encode() for t in "abcabc"] and made == list("abcc")

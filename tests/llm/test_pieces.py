import hashlib
import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgate.llm.pieces import MODEL, SPACE, Pieces, op11_merge_rounds, pieces, tokenized

SF = "/root/testdata/sf0.001"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
#: Blank runs, bytes, repeated letters and syllables, several scripts, the escaped space itself, names of special pieces.
ODD = ["", " ", "  ", "\n", " " * 3000, "a" * 3001, "ab" * 999, "ababa" * 501, "\t\t x", "naïve Straße Ελληνικά Привет 日本語 한국어 العربية", "😀👩‍👩‍👧 é", "\x00\x7f", f"{SPACE}a{SPACE}{SPACE}b", "<s></s><unk><0x0A>", "aaaaAAAAaaaa" * 200, "==== ---- ....", "�﻿", "0123456789" * 40]


def same(texts: list[str]) -> None:
    got = pieces().encode(texts)
    for text, ids in zip(texts, got):
        want = LIBRARY.encode(text)
        assert ids.tolist() == want, text[:80]
        assert pieces().decode(want) == LIBRARY.decode(want), text[:80]


def test_odd_texts_like_the_library():
    same(ODD)
    same([a + " " + b for a in ODD for b in ODD[:12]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aehinorst  t.\n▁,E0"), st.characters(codec="utf-8")), max_size=60), max_size=8))
def test_texts_like_the_library(texts):
    same(texts)


def test_unspaced_runs_of_every_piece_like_the_library():
    """Long words without a cut, where ranks come in every order and many merges make pairs that come before others."""
    rng = random.Random(7)
    texts = [LIBRARY.id_to_piece(k) for k in range(259, LIBRARY.get_piece_size())]
    letters = [t for t in texts if t.isascii() and t.isalpha() and t.islower()]
    same(["".join(rng.choices(letters, k=rng.choice([3, 30, 900]))) for _ in range(150)])
    same(["".join(rng.choices(texts, k=200)) for _ in range(60)])
    same(["".join(rng.choices("etaoinsh", k=n)) for n in (10, 100, 1000, 20000)])


def test_ids_are_decoded_like_the_library():
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.randrange(LIBRARY.get_piece_size()) for _ in range(rng.randrange(12))]
        ids += [rng.randrange(3, 259) for _ in range(rng.randrange(6))]
        assert pieces().decode(ids) == LIBRARY.decode(ids), ids


def test_a_worker_that_remembers_nothing_gives_the_same(monkeypatch):
    monkeypatch.setattr("sparkgate.llm.pieces.MEMORY", 0)
    model = Pieces(public_tokenizers.path(MODEL))
    assert [x.tolist() for x in model.encode(ODD)] == [LIBRARY.encode(t) for t in ODD]
    assert not model.known


def test_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_merge_rounds(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    rows = [(1, "a b", 5), (1, "a b", 6), (None, None, 7), (2, "", 8), (3, "word " * 300_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("decoded", F_lit())
    got = {(r.doc_id, r.decoded): list(r.ids) for r in tokenized(docs).collect()}
    assert got[(1, "a b")] == LIBRARY.encode("a b") and got[(None, "")] == [] and got[(2, "")] == []
    assert got[(3, "word " * 300_000)] == LIBRARY.encode("word " * 300_000)
    assert tokenized(docs).count() == 5 and tokenized(docs.where("false")).count() == 0


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("x")

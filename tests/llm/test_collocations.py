import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkgate.llm.collocations import OP12_SQL, SCORE, Filter, _packed, _summed, _unpack, _unpacked, collocations, op12_phrase_lists, postings
from sparkgate.session import shared_dir

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows: list[tuple], least: int, most: int) -> set[tuple]:
    """Every phrase counted in a dictionary, every cut and every longer candidate looked at."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = [(lang, p) for (lang, p), a in f.items() if len(p) > 1 and a >= least]
    out = {}
    for lang, p in candidates:
        a = f[lang, p]
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        longer = [q for x, q in candidates if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * f[lang, q] >= 80 * a for q in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:most])}


def drawn(seed: int, size: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "é", "Straße", "a", "a", "b\x00", "x-y"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "\r\n", "\x0b"]
    text = lambda: "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(40)))
    return [(rng.choice([None, "", text(), text(), "new york city hall is big. new york"]), rng.choice(["en", "en", "de", None, "und"])) for _ in range(size)]


def test_like_brute_force_over_many_blocks(spark):
    for seed, block in ((1, 50), (2, 1 << 17)):
        rows = drawn(seed, 150)
        docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
        for least, most in ((4, 2000), (9, 7)):
            got = collocations(docs, least=least, most=most, block_words=block).select(*COLUMNS).collect()
            assert {tuple(r) for r in got} == plain(rows, least, most)
            assert len(got) == len(set(got))


def test_overlapping_occurrences_count(spark):
    docs = spark.createDataFrame([("go go go go",)] * 12, "text string").withColumn("lang", F.lit(None).cast("string"))
    got = {r.phrase: r for r in collocations(docs, least=10, inside=(101, 100)).collect()}
    assert {p: r.a for p, r in got.items()} == {"go go": 36, "go go go": 24, "go go go go": 12}
    assert (got["go go"].l, got["go go"].n, got["go go"].score) == (48, 48, 2000000 * 36 // 96)


def test_positions_are_exact_and_lists_ascend(spark):
    lists = postings(spark.createDataFrame([("b a b. b",), ("a",)], "text string").coalesce(1).withColumn("lang", F.lit("x"))).collect()
    (row,) = lists
    lengths, steps = _unpack(row.lengths), _unpack(row.positions)
    assert dict(zip(row.phrases, lengths.tolist())) == {"b": 3, "a": 2}
    assert np.cumsum(steps).tolist() == [0, 2, 4, 1, 6]


def test_a_filter_knows_all_it_holds_and_few_others(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 40, 3000).astype(np.uint64)
    known = Filter(spark.createDataFrame([(int(k),) for k in keys], "key long"), 40)
    assert known.has(keys | np.uint64(5 << 50)).all() and known.has(rng.integers(0, 1 << 62, 3000).astype(np.uint64)).mean() < 0.1
    assert not Filter(spark.createDataFrame([], "key long"), 40).has(keys).any()


def test_counts_are_packed_and_added_up():
    rng = np.random.default_rng(2)
    keys, counts = _summed(rng.integers(0, 1 << 50, 5000).astype(np.uint64), rng.integers(1, 300, 5000))
    row = _packed(7, keys, counts)
    back, times = _unpacked(row["n"][0].as_py(), row["data"][0].as_py())
    assert (back == keys).all() and (times == np.minimum(counts, 255)).all()
    assert [x.tolist() for x in _summed(np.array([3, 1, 3], dtype=np.uint64), np.array([1, 2, 5]))] == [[1, 3], [2, 6]]


def test_tasks_that_send_on_early_change_nothing(spark, monkeypatch):
    monkeypatch.setattr("sparkgate.llm.collocations.HELD_COUNTS", 10)
    monkeypatch.setattr("sparkgate.llm.collocations.SHARE_WORDS", 100)
    rows = drawn(4, 150)
    got = collocations(spark.createDataFrame(rows, "text string, lang string"), least=4, block_words=60).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == plain(rows, 4, 2000)


def test_a_filter_that_is_too_small_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr("sparkgate.llm.collocations.FILTER_BITS", 64)
    rows = drawn(3, 150)
    got = collocations(spark.createDataFrame(rows, "text string, lang string"), least=4).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == plain(rows, 4, 2000)


def test_scores_pass_64_bits(spark):
    a, l, r = 9 * 10**18, 9 * 10**18, 9 * 10**18 + 7  # noqa: E741
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(F.expr(SCORE)).head()[0]
    assert got == 2000000 * a // (l + r)


def test_documents_like_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(OP12_SQL).fetchall()
    got = op12_phrase_lists(spark, SF).select(*COLUMNS).collect()
    assert len(want) > 20 and {tuple(r) for r in got} == set(want) and len(got) == len(want)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([("a b", "en", 1, "x")] * 3, "text string, lang string, block long, phrase string")
    assert [r.phrase for r in collocations(docs, least=3).collect()] == ["a b"]
    assert collocations(docs.where("false")).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("...", "en")], "text string, lang string")).count() == 0


def test_a_long_text_is_one_block(spark):
    docs = spark.createDataFrame([("x y z " * 100_000, "en")], "text string, lang string")
    got = {r.phrase: r.a for r in collocations(docs, block_words=1000, inside=(101, 100)).collect()}
    assert got["x y"] == 100_000 and got["z x"] == 99_999 and got["z x y z"] == 99_999


def test_nothing_stays_behind(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    collocations(spark.createDataFrame([("a b", "en")] * 3, "text string, lang string"), least=3).collect()
    assert [p.name.split("-")[1] for p in set(folder.iterdir()) - before] == ["collocations"]


def test_blocks_go_to_python_in_small_batches(spark, monkeypatch):
    """A task's batch holds a few blocks, not all of them, and the session's own setting comes back."""
    from sparkgate.llm import collocations as c

    name, seen, read = "spark.sql.execution.arrow.maxBytesPerBatch", [], c._stored
    before = spark.conf.get(name)
    monkeypatch.setattr(c, "_stored", lambda lists: seen.append(spark.conf.get(name)) or read(lists))
    collocations(spark.createDataFrame([("a b. a b", "x")] * 40, "text string, lang string"), block_words=64).count()
    assert seen and all(int(x.rstrip("b")) == c.BATCH_BYTES for x in seen) and spark.conf.get(name) == before

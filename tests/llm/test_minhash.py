import random
import re

import duckdb
import pytest

from sparkgate.llm import minhash
from sparkgate.llm.minhash import OP6_SQL, near_duplicates, op6_hamming_near_dedup, shingle_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    docs, base = [], [rng.choices(vocab, k=rng.randrange(20, 200)) for _ in range(40)]
    for b in base:
        for _ in range(rng.randrange(1, 9)):
            c = list(b)
            for _ in range(rng.randrange(0, 8)):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            docs.append(" ".join(c))
    passage = " ".join(rng.choices(vocab, k=60))
    docs += [passage + " " + " ".join(rng.choices(vocab, k=40)) for _ in range(30)]
    hub = rng.choices(vocab, k=150)
    for k in range(60):  # each is near the hub, many are not near each other
        c = list(hub)
        for p in rng.sample(range(150), 3):
            c[p] = f"x{k}_{p}"
        docs.append(" ".join(c))
    docs += ["One two", "one  TWO", "one two three", "É a", "é a", "", " \n", docs[0], docs[0].upper(), "a b c d e\tf\x0bg"]
    rng.shuffle(docs)
    return list(enumerate(docs)) + [(len(docs), None)]


def test_words_and_shingles():
    assert len(word_hashes(b" Ab\tab\n AB\x0c")) == 3 and len(set(word_hashes(b" Ab\tab\n AB").tolist())) == 1
    assert len(word_hashes("É é".encode())) == 2 and len(set(word_hashes("É é".encode()).tolist())) == 2
    rng = random.Random(1)
    for _ in range(200):
        t = " ".join(rng.choices("abcd", k=rng.randrange(0, 40)))
        assert len(shingle_hashes(t.encode())) == len(shingles(t))


@pytest.mark.parametrize("few, tile", [(16, 1024), (3, 20)])
def test_components_match_brute_force(spark, monkeypatch, few, tile):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "TILE", tile)
    docs = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, keys string").repartition(3)).collect()}
    assert got == brute(docs)


def test_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text), (2, None)], "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (2, 2, True), (5, 5, True), (5, 5, True), (9, 5, False)]
    assert sum(r.chosen for r in got if r.doc_id == 5) == 1 and sum(r.chosen for r in got) == 3
    assert near_duplicates(docs.limit(0)).count() == 0


def test_an_id_with_two_texts(spark):
    a, b = " ".join(map(str, range(60))), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(5, a, 1), (5, b, 2), (7, a + " x", 3), (8, b + " x", 4), (9, a, 5), (10, b, 6)], "doc_id long, text string, n long")
    got = near_duplicates(docs, carried=("n",)).collect()
    assert {r.component_id for r in got} == {5} and sorted(r.n for r in got if r.chosen) == [1, 2]


def test_sketch_loses_less_than_the_keys():
    assert minhash.far_loss(0.75) < 2e-7 and minhash.far_loss(0.8) < 1e-9
    assert all(minhash.far_loss(s / 100) <= minhash.far_loss(0.75) for s in range(75, 101))


def test_near_pairs_are_found(spark):
    """Many pairs of similarity 0.75 to 0.8, the hardest for the index."""
    rng = random.Random(5)
    docs, want = [], set()
    for k in range(1500):
        words = [f"{k}_{i}" for i in range(rng.randrange(60, 120))]
        other = list(words)
        for _ in range(rng.choice((1, 2, 3))):
            other[rng.randrange(len(other))] = "z"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        x, y = shingles(docs[-2][1]), shingles(docs[-1][1])
        if 75 <= 100 * len(x & y) / len(x | y) <= 80:
            want.add(k)
    got = {r.doc_id // 2 for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).where("not kept").collect()}
    assert len(want) > 200 and want <= got


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(OP6_SQL).fetchall())
    assert sorted(tuple(r) for r in op6_hamming_near_dedup(spark, sf).collect()) == want

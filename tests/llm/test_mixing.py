import duckdb
import pytest

from sparkgate.llm.mixing import OP9_SQL, mix_sources, mixed_documents, op9_pareto_mix, source_targets


def test_targets_stop_at_the_cap_and_share_the_rest(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 90)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sizes, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    # 450 words; a is full at 20; b:2, c:1, null:5 share 430, null is full at 180; 250 by 2:1
    assert got == {"a": 20.0, None: 180.0, "b": pytest.approx(250 * 2 / 3), "c": pytest.approx(250 / 3)}


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (i % 50), ["x", "y", "z", None][i % 4], "extra") for i in range(2000)] + [(5000, None, "x", ""), (None, "a b", "y", ""), (7, "w " * 7, "z", ""), (7, "w " * 7, "z", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    for s in ("x", "y", "z", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 25
        assert own[0].source_size == sum(r.size for r in own)
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_empty_and_wordless_tables(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = mix_sources(spark.createDataFrame([(1, " ", "s"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(OP9_SQL).fetchall()}
    got = {r.doc_id: r[1:] for r in op9_pareto_mix(spark, sf).collect()}
    assert got == want


def test_odds_grow_with_size(spark):
    """Of a source that gives a third of its words, documents twice as long are drawn about twice as often."""
    docs = spark.createDataFrame([(i, "w " * (10 if i % 2 else 20), "s") for i in range(6000)] + [(i, "w " * 30, "t") for i in range(6000, 9000)], "doc_id long, text string, source string")
    got = [r for r in mix_sources(docs, weights=(1.0, 2.0), share=0.5).collect() if r.source == "s"]
    assert abs(sum(r.taken for r in got) - got[0].target) <= 10
    share = {n: sum(r.copies for r in got if r.size == n) / 3000 for n in (10, 20)}
    assert 1.8 < share[20] / share[10] < 2.2
    # Where doubling would pass 1, the longest are certain and the others make up for the rest.
    rest = [r for r in mix_sources(docs, weights=(4.0, 1.0), share=0.6).collect() if r.source == "s"]
    extra = {n: [r.copies - min(x.copies for x in rest) for r in rest if r.size == n] for n in (10, 20)}
    assert all(e == 1 for e in extra[20]) and 0 < sum(extra[10]) < 3000

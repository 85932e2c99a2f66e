import base64
import hashlib
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkgate.llm.warc import OP8_SQL, chunked, dechunk, op8_warc_segments, parse, read_archives, read_records, reassemble, records, write_archives

PAGES = [(1, "http://a/", "<p>é😀</p>" * 2000, 0), (2, "http://b/\n", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n0\r\n\r\n", 0), (3, None, None, 0), (4, "u", "", 0), (9, "u", "same", 0), (7, "ü", "same", 0), (8, "u", "x" * 70_000, 0)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload int").repartition(3)
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    write_archives(pages, path, segment=700)
    rows = read_records(spark, path).collect()
    assert max(len(r.block) for r in rows) <= 700 and any(r.record_type == "continuation" for r in rows)
    got = {r.record_id: r for r in read_archives(spark, path).collect()}
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    assert len(got) == len(PAGES)
    for page, payload in html.items():
        r = got[f"<urn:page:{page}>"]
        assert r.digest == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.record_type == ("revisit" if page in (4, 9) else "response")
        assert r.payload == (None if page in (4, 9) else payload)
    assert got["<urn:page:9>"].refers_to == "<urn:page:7>" and got["<urn:page:4>"].refers_to == "<urn:page:3>"


def test_smaller_payloads_are_all_responses(spark):
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string, x int"), path, least_bytes=5)
    assert {r.record_type for r in read_archives(spark, path).collect()} == {"response"}


def test_incomplete_segments_have_no_payload(spark):
    rows = [("o1", "o1", "response", None, "d", "u", 1, None, b"ab"), ("c", "o1", "continuation", None, None, "u", 3, 6, b"ef"), ("o2", "o2", "response", None, "d", "u", 1, None, b"ab"), ("c", "o2", "continuation", None, None, "u", 2, 5, b"cd"), ("c", "o3", "continuation", None, None, "u", 2, 4, b"cd"), ("o3", "o3", "response", None, "d", "u", 1, None, b"ab")]
    df = spark.createDataFrame(rows, "record_id string, origin string, record_type string, refers_to string, digest string, url string, segment int, total long, block binary")
    got = {r.record_id: r.block for r in reassemble(df).collect()}
    assert got["o1"] is None and got["o2"] is None and bytes(got["o3"]) == b"abcd"


def test_framing():
    for payload in (b"", b"x", b"\r\n0\r\n\r\n" * 999, bytes(range(256)) * 100):
        assert dechunk(chunked(payload, 10)) == payload
    with pytest.raises(ValueError):
        dechunk(b"5\r\nabc\r\n0\r\n\r\n")
    raw = b"".join(records(1, "u", b"abc" * 99, "D", None, 50))
    assert len(list(parse(iter([raw[k : k + 7] for k in range(0, len(raw), 7)])))) == len(list(parse(iter([raw]))))
    with pytest.raises(ValueError):
        list(parse(iter([raw[:-20]])))


def test_empty_table(spark):
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(con.execute(OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in op8_warc_segments(spark, sf).collect()) == want


def test_null_and_repeated_ids_match_sql(spark, tmp_path):
    long, other = "é" * 50_000, "o" * 80_000
    rows = [(1, "u", long), (1, "u", long), (3, "u", long), (None, "u", long), (None, "u", "alone"), (None, None, None), (5, "a", "short"), (5, "a", "short"), (5, "b", other), (6, "c", "short"), (6, "c", "short"), (7, "d", other), (8, "e", "one"), (-2, "f", "one")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in op8_warc_segments(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(OP8_SQL).fetchall(), key=str) and len(got) == len(rows)
    assert all(r[1] is not None for r in got)
    path = f"{tmp_path}/archive"
    write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    read = {r.record_id: r for r in read_archives(spark, path).collect()}
    assert len(read) == len(rows)
    assert all(read[r.refers_to].record_type == "response" and read[r.refers_to].digest == r.digest for r in read.values() if r.record_type == "revisit")


def test_pages_without_an_id_revisit_one_that_has_it(spark, tmp_path):
    """Type and target are what the archive says, not what the query makes of it."""
    rows = [(None, "u", "x", 1), (None, "v", "x", 2), (3, "w", "x", 3), (None, "u", "y", 4), (None, "u", "y", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = str(tmp_path / "archives")
    write_archives(pages, path)
    got = sorted((r.record_type, r.refers_to or "", r.record_id == "<urn:page:3>") for r in read_archives(spark, path).collect())
    assert got == [("response", "", False)] * 2 + [("response", "", True)] + [("revisit", "<urn:page:3>", False)] * 2
    pages.select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({OP8_SQL})").fetchall(), key=key)
    assert sorted((tuple(r) for r in op8_warc_segments(spark, str(tmp_path)).select(*names).collect()), key=key) == want

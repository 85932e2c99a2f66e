"""Files, datasets and edge cases of the evidence operators."""

import json

import pytest
from pyspark.sql import functions as F

from sparkgate.operators import evidence, graph, resolve
from sparkgate.sources import files


def test_source_files(spark, tmp_path):
    for rel, data in {"a.py": b"x = 1", "b/c.tsx": b"t", "b/none.py": b"", "b/types.d.ts": b"x", "node_modules/d.js": b"x", "b/e.txt": b"x", ".hidden/f.py": b"x", "b/g.py": b"\xff\xfe", "h.mjs": b"y" * (files.MAX_FILE_BYTES + 1), "build.py": b"z", ".gitignore": b"*.ts\n!d.ts\n", "out.ts": b"x", "d.ts": b"x", "b/.gitignore": b"/d.py", "b/d.py": b"x"}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(data)
    got = {r.rel: (r.grammar, r.bytes, r.state, r.text) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("python", 5, "ok", "x = 1"), "b/c.tsx": ("tsx", 1, "ok", "t"), "b/none.py": ("python", 0, "ok", ""), "b/g.py": ("python", 2, "not_utf8", None), "h.mjs": ("javascript", files.MAX_FILE_BYTES + 1, "too_large", None), "build.py": ("python", 1, "ok", "z"), "d.ts": ("typescript", 1, "ok", "x")}


def test_numbered_lines_over_splits(spark, tmp_path):
    want = {}
    for name, n in (("a.txt", 900), ("b.txt", 37)):
        lines = ["" if k % 10 == 9 else f"{name} {k}" for k in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want |= {(name, k + 1): line for k, line in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.file.rpartition("/")[2], r.line): r.value for r in rows} == want and len(rows) == len(want)


def test_dataset_is_in_order(spark, tmp_path):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), "id")
    files.write_dataset(df, str(tmp_path / "out"))
    rows = [json.loads(x) for part in sorted((tmp_path / "out").glob("part-*")) for x in part.read_text().splitlines()]
    assert [r["hash"] for r in rows] == sorted(r["hash"] for r in rows) and {r["id"] for r in rows} == set(range(500))


def test_supplied_rows_edge_cases(spark):
    texts = ["", None, '{"site": "s", "input": {}, "reference": null}', '{"site": "s", "input": []}', '{"input": {}}', '{"site": null, "input": {}}']
    rows = files.supplied_rows(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line long, value string")).collect()
    assert {r.line: (r.site, r.input, r.reference, r.invalid) for r in rows} == {2: ("s", "{}", None, False), 3: (None, None, None, True), 4: (None, None, None, True), 5: (None, None, None, True)}


def test_empty_tables(spark):
    stages = spark.createDataFrame([], "site long, at int, stage string, requests long, concurrent long, expected long, worst long, reservation long")
    assert tuple(evidence.run_estimate(stages).first()) == (0, 0, 0, None, 0)
    assert tuple(evidence.adjudication(spark.createDataFrame([], "agrees boolean, verdict_status string, sided_with string")).first()) == (0,) * 8
    imports = spark.createDataFrame([], "id int, exact array<string>, suffixes array<string>, package string")
    assert resolve.resolve_imports(imports, spark.createDataFrame([], "rel string")).count() == 0


def test_stage_ties_go_to_the_first(spark):
    stages = spark.createDataFrame([(2, 1, "late", 1, 9, 1, 1, 5), (1, 2, "first", 1, 8, 1, 1, 5), (1, 3, "second", 1, 8, 1, 1, 5)], "site long, at int, stage string, requests long, concurrent long, expected long, worst long, reservation long")
    assert tuple(evidence.run_estimate(stages).first()) == (3, 3, 3, "first", 40)


@pytest.mark.parametrize("status, called", [("distinct", True), ("folded", False)])
def test_only_distinct_roots_represent(spark, status, called):
    nodes = spark.createDataFrame([(1, status), (2, "distinct"), (3, "folded"), (4, "folded")], "node long, status string")
    edges = spark.createDataFrame([(1, 2, False), (3, 4, True), (4, 3, True)], "src long, dst long, fold boolean")
    got = {r.node: (r.represented, r.live) for r in graph.represented_and_live(nodes, edges).collect()}
    # 3 and 4 call only each other: not grounded, so not represented, so live.
    assert got == {1: (False, True), 2: (called, not called), 3: (False, True), 4: (False, True)}

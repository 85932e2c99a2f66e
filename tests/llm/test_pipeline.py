"""Each stage of the pipeline against a plain version of what it decides, on its own input."""

import tempfile
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkgate.llm.packing import TOKENIZER
from sparkgate.llm.quality import op5_quality_ratio
from sparkgate.session import shared_dir
from tests.llm.test_minhash import brute, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = tempfile.mkdtemp(prefix="spark-stage-") + f"/{k}"
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_columns_stay(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_what_the_operator_keeps(spark, steps):
    kept = {r.doc_id for r in op5_quality_ratio(spark, SF).collect() if r.kept}
    assert {r.doc_id for r in steps[0][1].collect()} == kept


def test_one_document_of_each_group_stays(steps):
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in steps[1])
    want = {d for d, (_, c) in brute(before).items() if d == c}
    assert sorted(d for d, _ in after) == sorted(want)


def test_only_live_secrets_change(steps):
    before, after = ({r.doc_id: r for r in x.collect()} for x in steps[2])
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert r.text == before[d].text or "[SECRET]" in r.text
        assert r.n_chars == len(r.text)


def test_mix_is_near_the_targets(steps):
    before, after = (x.collect() for x in steps[3])
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    longest = max(len(r.text.split()) for r in before)
    assert abs(size(after) - 1.5 * size(before)) <= longest * len({r.source for r in before})
    assert max(Counter(r.doc_id for r in after).values()) <= 2


def test_packing_holds_every_id_of_every_copy(steps):
    docs, rows = (x.collect() for x in steps[4])
    whole = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = Counter()
    for r in docs:
        want[r.doc_id] += len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want


def test_repeated_and_null_ids_in_near_dedup(spark):
    text = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (3, None, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "None"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_shingles_are_those_of_the_contract():
    assert shingles("A b") == {("a", "b")}


def test_a_run_leaves_its_last_table_only(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [p.name.split("-")[1:3] for p in set(folder.iterdir()) - before] == [["stage", "mixing"]]

"""The pipeline's stages one after the other, each beside a plain version over what came before."""

from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from tests.llm.helpers import documents
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_neardup import plain_kept
from weekcast.llm.common import materialize
from weekcast.llm.mixing import mix_documents
from weekcast.llm.quality import classify_quality


@pytest.fixture(scope="module")
def stages(spark, folder):
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], folder), "stage"))
    return frames


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_stages_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line dedup", "simhash dedup", "mixing", "encoding"]
    assert all(f.columns == stages[0].columns for f in stages[:-1])
    counts = [f.count() for f in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0 and counts[0] > counts[1]


def test_quality_stage(spark, folder, stages):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id for r in classify_quality(stages[0], labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in stages[1].collect()} == good


def test_lines_stage(stages):
    want = {i: t for i, (t, gone) in plain_lines(texts(stages[1])).items() if t or not gone}
    assert dict(texts(stages[2])) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_simhash_stage(stages):
    assert {r.doc_id for r in stages[3].collect()} == plain_kept(texts(stages[2]))


def test_mixing_stage(stages):
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in mix_documents(stages[3]).collect()}


def test_run_is_the_chain_of_stages(spark, folder, stages):
    rows = sorted(tuple(r) for r in pipeline.run(spark, folder).collect())
    assert rows == sorted(tuple(r) for r in stages[-1].collect())


def test_awkward_documents_pass_every_stage(spark, folder):
    extra = ["1 AS score", "2 AS _removed", "3 AS removed_lines", "4 AS topic", "5 AS fp", "6 AS component_id", "7 AS id"]
    rows = documents(spark, [(None, None), (1, ""), (1, ""), (2, "a\nb\nc\n" * 3000), (3, None)], extra)
    for name, stage in pipeline.STAGES:
        out = stage(spark, rows, folder)
        assert out.count() <= 5 and (name == "encoding" or out.columns == rows.columns)
        assert stage(spark, rows.limit(0), folder).count() == 0

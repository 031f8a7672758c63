from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lexloom.llm import quality
from lexloom.llm.store import Workspace, table
from tests.llm.conftest import edge_rows
from tests.llm.test_passages import plain_shingles, share
from tests.llm.test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents and what each stage kept."""
    work = Workspace(spark, "pipeline", f"file://{tmp_path_factory.mktemp('pipeline')}")
    docs, found = table(spark, sf_dir, "documents"), {}
    found["documents"] = docs
    for name, stage in pipeline.STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
        found[name] = docs
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_quality(spark, sf_dir, stages):
    scores = quality.op7_quality(spark, sf_dir).where("predicted = 1")
    assert ids(stages["quality"]) == ids(scores)


def test_near_duplicates(stages):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in stages["quality"].collect()]
    assert ids(stages["near_duplicates"]) == sorted(set(plain_components(rows).values()))


def test_passages(stages):
    """No passage is left in two documents; those that shared none are as they were."""
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    after = {r.doc_id: r.text for r in stages["passages"].collect()}
    assert set(after) <= set(before)
    grams = {d: plain_shingles(t) for d, t in before.items()}
    sharing = {d for a in before for b in before if a < b and len(set(grams[a]) & set(grams[b])) >= 37
               and share(grams[a], grams[b]) for d in (a, b)}
    assert {d for d in before if after.get(d) != before[d]} <= sharing
    left = {d: plain_shingles(t) for d, t in after.items()}
    assert not [1 for a in left for b in left if a < b and len(set(left[a]) & set(left[b])) >= 37
                and share(left[a], left[b])]
    assert all(r.n_chars == len(r.text) for r in stages["passages"].collect() if after[r.doc_id] != before[r.doc_id])


def test_benchmark(spark, sf_dir, stages):
    low = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    bench = [low(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = stages["passages"].collect()
    assert ids(stages["benchmark"]) == sorted(r.doc_id for r in rows if not any(q in low(r.text) for q in bench))


def test_mixing(stages):
    words = lambda t: len((t or "").encode().split())
    total = sum(words(r.text) for r in stages["benchmark"].collect())
    rows = stages["mixing"].collect()
    assert sum(r.tokens_taken for r in rows) == total * 3 // 4
    assert all(0 <= r.tokens_taken <= words(r.text) for r in rows)
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)


def test_columns(stages):
    for name in ("quality", "near_duplicates", "passages", "benchmark"):
        assert stages[name].dtypes == stages["documents"].dtypes


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_edges_of_each_stage(spark, docs, sf_dir, name):
    stage = dict(pipeline.STAGES)[name]
    edges = docs(edge_rows())
    got = stage(spark, edges, sf_dir)
    assert set(edges.columns) <= set(got.columns)
    assert {r.doc_id for r in got.collect()} <= {d for d, _ in edge_rows()}
    assert stage(spark, docs([]), sf_dir).collect() == []

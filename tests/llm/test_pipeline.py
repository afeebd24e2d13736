"""The pipeline against a brute-force version of its stages, and its registration."""

import collections
import hashlib
import json

import pytest

import corpus_pipeline as C
from codeframe.llm import queries

from .test_operators import brute_components, brute_repeats, planted

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 300")
    out = [docs]
    for name, f in C.STAGES:
        out.append(C.write_shared(f(spark, out[-1], DIR), name))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_are_named_and_keep_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "byte_bpe"]
    assert all(df.columns == stages[0].columns for df in stages[1:5])
    assert C.ORACLE_SQL is None and "pipeline" in queries.queries() and len(queries.queries()) == 11
    assert [n for n in queries.queries() if n.startswith("op")] == sorted((n for n in queries.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))


def test_quality_stage_drops_what_labels_call_bad(stages, spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    seen = [(r.quality, r.doc_id in kept) for r in labels.where("doc_id < 300").collect()]
    assert sum(k == (q == 1) for q, k in seen) >= 0.95 * len(seen)


def test_near_dedup_stage_equals_brute_force(stages):
    want = {i for i, _, c in brute_components(rows(stages[1])) if i == c}
    assert sorted(i for i, _ in rows(stages[2])) == sorted(want)


def test_suffix_stage_equals_brute_force(stages):
    want = {i: (gone, sha) for i, _, gone, _, sha in brute_repeats(rows(stages[2]))}
    before = dict(rows(stages[2]))
    for i, t in rows(stages[3]):
        assert len(t.encode()) <= len(before[i].encode()) - want[i][0]
        if want[i][0] == 0:
            assert t == before[i]


def test_mixing_and_tokens(stages):
    before, after = collections.Counter(rows(stages[3])), collections.Counter(rows(stages[4]))
    assert set(after) <= set(before)
    texts = collections.defaultdict(list)
    for i, t in rows(stages[4]):
        texts[i].append(hashlib.sha256(t.encode()).hexdigest())
    got = collections.defaultdict(list)
    for r in stages[5].collect():
        got[r.doc_id].append(r.decoded_sha256)
        assert len(r.ids) == r.n_tokens
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_pipeline_on_planted_passages(spark):
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in planted()], "doc_id long, text string, lang string, source string, n_chars long")
    out = C.repeats(spark, docs, DIR)
    assert out.count() == docs.count() and json.dumps(out.columns) == json.dumps(docs.columns)


def test_empty_input(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, f in C.STAGES:
        docs = C.write_shared(f(spark, docs, DIR), name)
        assert docs.count() == 0

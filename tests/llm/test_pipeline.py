"""The pipeline's stages against what they must drop and keep."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from llm.test_decontaminate import brute as leaks_by_brute_force
from llm.test_similar import brute as groups_by_brute_force
from tokenizers import Tokenizer

from sowmill.llm.secrets import redacted
from sowmill.llm.toxicity import CUT, score_held_out


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_toxicity_stage(spark, sf_dir, stages):
    scores = {r.doc_id: r.score for r in score_held_out(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert set(rows(stages[1])) == {k for k, s in scores.items() if s < CUT}
    assert len(rows(stages[1])) > 0.7 * len(scores)


def test_near_copies_stage(stages):
    texts = {k: r.text for k, r in rows(stages[1]).items()}
    roots, _ = groups_by_brute_force(texts, 5, 80)
    assert set(rows(stages[2])) == set(roots.values()) and len(set(roots.values())) < len(texts)


def test_benchmark_stage(spark, sf_dir, stages):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = {k: r.text for k, r in rows(stages[2]).items()}
    short = dict(sorted(texts.items(), key=lambda x: len(x[1] or ""))[:90])
    held = {k for k, _ in leaks_by_brute_force(short, items)}
    left = set(rows(stages[3]))
    assert left & set(short) == set(short) - held and left <= set(texts)


def test_secrets_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for key, r in after.items():
        assert r.text == redacted(before[key].text, "[SECRET]") and r.n_chars == len(r.text)


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = Counter()
    for r in stages[5].collect():
        total[r.doc_id] += r.length
    assert total == {k: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for k, r in rows(stages[4]).items()}


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    def lengths(df):
        return sorted((r.doc_id, r.n) for r in df.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect())

    assert lengths(corpus_pipeline.run(spark, sf_dir)) == lengths(stages[5])


def test_stages_take_odd_rows(spark, sf_dir, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert np.sum([r.length for r in packed.collect()]) >= docs.count()

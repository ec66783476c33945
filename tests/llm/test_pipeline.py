from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brooklet.llm import mixing, pii, quality

from . import edge
from .test_joins import plain_jaccard


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    trees = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), may_learn=quality.learnable())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "packing":
            assert docs.columns == names
        if name == "quality":
            keep = trees.predict(quality.matrix([r.text for r in before])) >= 0.7
            assert Counter(after) == Counter(r for r, k in zip(before, keep) if k)
        elif name == "near_duplicates":
            _, root = plain_jaccard([(r.doc_id, r.text) for r in before])
            least = {}
            for n, g in root.items():
                least[g] = min(least.get(g, before[n].doc_id), before[n].doc_id)
            assert Counter(r.doc_id for r in after) == Counter(least.values()) and set(after) <= set(before)
        elif name == "pii":
            found = pii.find(pii.trained(), [r.text for r in before])
            want = Counter((r.doc_id, pii.redacted(r.text, spans)) for r, (_, spans) in zip(before, found))
            assert Counter((r.doc_id, r.text) for r in after) == want and all(r.n_chars == len(r.text) for r in after)
            assert not any(pii.base_spans(r.text) for r in after)
        elif name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before, edge.SCHEMA.split(", score")[0])).collect()}
            assert set(after) <= set(before) and max(Counter(after).values()) <= 3
            assert sum(taken.values()) == pytest.approx(len(after), rel=0.2)
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = Counter()
            for r in before:
                want.update(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])
            got = Counter()
            for r in after:
                got.update(np.frombuffer(r.ids, "<u4").tolist())
            assert got == want


@pytest.mark.parametrize("rows", [edge.rows(), []])
def test_stages_bear_edges(spark, sf, tmp_path, rows):
    docs = spark.createDataFrame(rows, edge.SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        assert name == "packing" or got.columns == docs.columns
        got.write.parquet(str(tmp_path / name))
        if name == "packing":
            assert sum(r.length for r in got.select("length").collect()) >= docs.count()
        docs = spark.read.parquet(str(tmp_path / name))


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0

import random
from collections import Counter

import corpus_pipeline
import pytest

from tramline.llm import base, editmatch, subwords

from .conftest import DOCS
from .test_dedup import brute_classes, normal
from .test_text_models import quality_rows
from .test_tokens_packing_records import check_pieces


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(5)
    rows = quality_rows(400)
    item = " ".join(rng.choice(rows)[1].split()[:20])
    docs = [(i, t if i % 29 else f"{t} {item}", "en", "a", len(t), "n", "s", "k") for i, t, _ in rows] + [(1000, None, None, None, None, None, None, None), (1001, "", "en", "a", 0, "n", "s", "k")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_each_stage_equals_brute_force(spark, sf_dir):
    docs, texts = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = base.materialize(stage(spark, docs, sf_dir), name)
        if name == "pack":
            check_pieces(after.collect(), list(before.items()), 1024)
            assert sorted(map(tuple, after.select("doc_id", "start").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start").collect()))
            break
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.collect()}
        if name == "quality":
            model = subwords.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scores = dict(zip(before, subwords.Scorer(model).scores([t or "" for t in before.values()])))
            assert kept == {i for i, s in scores.items() if s >= 0.3} and len(kept) < len(before)
        elif name == "exact":
            assert sorted(normal(before[i]) for i in kept) == sorted(set(map(normal, before.values())))
        elif name == "near":
            classes = dict(zip(before, brute_classes(list(before.values()))))
            assert Counter(classes[i] for i in kept) == Counter(set(classes.values()))
        else:
            item = editmatch.normalize(spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text)
            assert kept == {i for i, t in before.items() if item not in editmatch.normalize(t)} and len(kept) < len(before)
        docs = after

"""The pipeline's stages on a small table, against decisions made by hand."""

import numpy as np
import pytest

import corpus_pipeline
from mentionflow.llm import common, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    path = str(tmp_path_factory.mktemp("tables"))
    words = ["tree", "house", "river", "stone", "light", "green", "water", "open", "field", "white"]
    rows = [(i, " ".join(rng.choice(words, 40)) + (" awful fool" * 3 if i % 4 == 0 else ""), "en", "s", 1) for i in range(160)]
    base = " ".join(rng.choice(words, 80))
    rows += [(500, base, "en", "s", 1), (501, base, "en", "s", 1), (502, f"{base} white", "en", "s", 1)]
    rows += [(600, None, "en", "s", 1), (601, "", None, "s", 1), (602, "12 34 !!", None, "s", 1), (603, "日本語のテキスト" * 5, None, "s", 1), (None, "the river and the house " * 9, None, "s", 1)]
    rows += [(1, "awful fool awful fool awful fool", "en", "s", 1)]  # a toxic row under a clean row's key
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160) if i != 1], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.by_language(spark, docs, folder)
    assert kept.columns == docs.columns
    left = {(r["doc_id"], r["text"]) for r in docs.collect()} - {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert {k for k, _ in left} == {600, 601, 602, 603}
    clean = corpus_pipeline.by_toxicity(spark, kept, folder)
    ids = [r["doc_id"] for r in clean.collect()]
    assert not {i for i in ids if i is not None and i < 160 and i % 4 == 0} and ids.count(1) == 1
    assert {i for i in range(160) if i % 4} | {500, 501, 502, None} == set(ids)
    single = [r["doc_id"] for r in corpus_pipeline.by_likeness(spark, clean, folder).collect()]
    assert sorted(i for i in single if i and i >= 500) == [500] and set(ids) - set(single) == {501, 502}


def test_run(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == {i for i in range(160) if i % 4} | {500, None}
    assert max(r["offset"] + r["length"] for r in pieces) <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "packing"]


def test_workers_hold_one_operator(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = [toxicity.words_of(r["text"]) for r in docs.collect()]
    assert not hasattr(model.scorer().spelling, "long") and (model.scorer().scores(texts) == model.scores(texts)).all()
    # What a kind of task keeps is gone in the next kind's task, and each text is sent once.
    common.kept("parser", lambda: "parser")
    left = []

    def run(batches):
        left.append(len(common._KEPT))
        yield from batches

    assert [list(common.freeing(run, keeps)(iter([1]))) for keeps in (True, False)] == [[1], [1]]
    assert left == [1, 0]
    given, schema = common.with_row(docs, "doc_id", "text", "score double", True)
    assert given.columns == ["own"] and schema.names == ["doc_id", "own", "score"]
    sent = given.toArrow().combine_chunks().to_batches()[0]
    found = [(k, t) for texts, (keys, own) in common.parts(sent, "doc_id", "text", True, 7) for k, t in zip(keys.to_pylist(), texts.to_pylist(), strict=True)]
    assert found == [(r["doc_id"], r["text"]) for r in docs.collect()]

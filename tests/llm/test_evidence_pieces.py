"""Evidence of more grams than one broadcast holds."""

import random

import numpy as np

from bayesloom.llm import toxicity


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pieces_of_evidence_give_the_same_features_and_move_no_symbols(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: bytes(rng.integers(97, 103, rng.integers(1, 6)).astype(np.uint8))
    texts = [b" ".join(word() for _ in range(n)).decode() for n in (*rng.integers(1, 60, 80), 4000)] + ["", None, "a"]
    grams = np.unique(np.concatenate([g for t in texts if t for g in toxicity.text_grams(t.encode())]))[::2]
    rows = [(int(g), float(e)) for g, e in zip(grams, rng.normal(size=len(grams)), strict=True)]
    evidence = spark.createDataFrame(rows, "gram long, whole double").repartition(3).cache()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r for r in toxicity.with_features(docs, evidence, "whole").collect()}
    assert len(whole) == len(texts) and len(rows) > 1000
    monkeypatch.setattr(toxicity, "LEAST", 1)
    for most, stretch in ((len(rows) // 3, 500), (len(rows) - 1, 1 << 22), (100, 2000)):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        pieced = toxicity.with_features(docs, evidence, "whole", most)
        assert shuffles(pieced) == 0  # before, each symbol was a row of a join and of two groupings
        assert {r.doc_id: r for r in pieced.collect()} == whole


def test_pipeline_drops_the_same_toxic_documents_by_pieces(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rng = random.Random(11)
    said = lambda k: " ".join(rng.choice(["ba", "ke", "lo"]) + rng.choice(["no", "ra", "ti"]) for _ in range(k))
    docs = spark.createDataFrame([(i, said(12) + (" grumpfing " + said(2) if i % 4 == 0 else "")) for i in range(400)], "doc_id long, text string")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    fit, monkeypatched = toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda d, known: monkeypatched.append(1) or fit(d, known, most=50))
    monkeypatch.setattr(toxicity, "LEAST", 50)
    pieced = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert monkeypatched and shuffles(pieced) == 0
    assert {r.doc_id for r in pieced.collect()} == kept and 290 <= len(kept) <= 310

"""Near duplicates in parts: what is shuffled goes part by part, and the links stay the same."""

import os
import random
from pathlib import Path

import pytest

from bayesloom.llm import minhash


def families(count, words, copies):
    """Texts of random words, each with near copies of a few words changed."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    texts = []
    for _ in range(count):
        text = [word() for _ in range(words)]
        texts.append(" ".join(text))
        for _ in range(copies):
            near = list(text)
            near[rng.randrange(words)] = word()
            texts.append(" ".join(near))
    return list(enumerate(texts))


def shuffled_bytes(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return sum(p.stat().st_size for d in dirs for p in Path(str(d.getPath())).rglob("shuffle_*.data"))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_files_of_sets_go_before_the_result_is_read(spark, no_broadcast):
    rows = families(150, 400, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of_sets = 8 * sum(len(t.split()) - 4 for _, t in rows)
    before, key = shuffled_bytes(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = spark.conf.get(key, None)
    found = minhash.near_duplicates(docs, 5)
    assert shuffled_bytes(spark) - before < of_sets / 2  # before, sets lay there twice, and bands and texts as well
    assert spark.conf.get(key, None) == conf
    assert all(r.component_id == r.doc_id // 4 * 4 for r in found.collect())


def test_parts_find_the_same_components(spark, monkeypatch):
    docs = spark.createDataFrame([*families(40, 60, 6), (999, ""), (998, None)], "doc_id long, text string")
    read = lambda: sorted(tuple(r) for r in minhash.near_duplicates(docs, 5).select("doc_id", "component_id", "kept").collect())
    whole, parts, in_parts = read(), [], minhash._in_parts
    monkeypatch.setattr(minhash, "LEAST", 1)
    monkeypatch.setattr(minhash._tiles, "__defaults__", (4,))
    monkeypatch.setattr(minhash, "_in_parts", lambda r, k, n, most, f: parts.append(n / most) or in_parts(r, k, n, most, f))
    assert read() == whole and len({c for _, c, _ in whole}) >= 42
    assert parts and parts[0] > 1


def test_pipeline_shuffles_no_texts_to_drop_copies(spark, no_broadcast, sf):
    import corpus_pipeline

    docs = spark.read.parquet(os.path.join(sf, "documents.parquet"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and 0 < kept.count() < docs.count()

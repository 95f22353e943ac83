"""Many spans in one text, candidates that repeat, and labels that all lie in one fold."""

import random
import time

from pyspark.sql import functions as F

from bayesloom.llm import personal, toxicity


def plain_candidates(text, base):
    """Every match against every span taken before it."""
    out, taken = [], [(s, e) for s, e, _ in base]
    for kind, pattern in personal.WIDER.items():
        if kind in personal.NEEDED and not personal.NEEDED[kind].search(text):
            continue
        new = []
        for m in pattern.finditer(text):
            start, end = m.span(1) if pattern.groups else m.span()
            if any(s < end and start < e for s, e in taken):
                continue
            votes = personal._votes(text, start, end, kind)
            if kind not in personal.CUED or 1 in votes[1:3]:
                new.append((start, end))
                out.append(personal.Candidate(start, end, kind, votes))
        taken += new
    return out


def test_candidates_equal_a_plain_search(spark, sf):
    rng = random.Random(1)
    words = ["4111 1111 1111 1111", "a@b.example", "10.0.0.1", "+49 (30) 123-4567", "5105105105105100", "api_key=sk1A9zQ7xY2wV5uT8s", "John Smith", "lorem", "12 Oak Street", "secret"]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(60)] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    for t in texts:
        assert personal.candidates(t, personal.base_spans(t)) == plain_candidates(t, personal.base_spans(t))


def test_very_many_spans_in_one_text():
    text = " ".join(f"4111 1111 1111 1111 x {10**15 + i}" for i in range(20_000))
    began = time.perf_counter()
    base = personal.base_spans(text)
    personal.candidates(text, base)
    assert time.perf_counter() - began < 20


def test_repeated_candidates_do_not_fill_the_sample(spark, sf):
    """One pattern in many copies leaves the others in: what was accepted before is accepted still."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = next(r.text for r in docs.collect() if r.text and personal.candidates(r.text, personal.base_spans(r.text)))
    copies = spark.range(3000).select((F.col("id") + 10**6).alias("doc_id"), F.lit(one[:400] if personal.candidates(one[:400], personal.base_spans(one[:400])) else one).alias("text"))
    few = personal.fit(docs, 200)
    many = personal.fit(docs.unionByName(copies), 200)
    agree = total = 0
    for r in docs.collect():
        for c in personal.candidates(r.text or "", personal.base_spans(r.text or "")):
            total += 1
            agree += few.accepts(r.text, c) == many.accepts(r.text, c)
    assert total and agree >= 0.9 * total


def test_toxic_labels_in_one_fold_still_give_a_model(spark, sf):
    """All toxic training labels in one of the two folds: the model is fitted, and ranks the toxic ones first."""
    rows = [(i, f"calm words about gardens number {i % 17} and rivers", 0) for i in range(200)]
    known = toxicity.training(spark.createDataFrame([(i, 0) for i in range(2000)], "doc_id long, toxic int"))
    bad = [r.doc_id for r in known.where("fold = 0 AND doc_id >= 500").limit(8).collect()]
    rows += [(i, f"you vile rotten idiot {k}", 1) for k, i in enumerate(bad)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert min(got[i] for i in bad) > max(got[i] for i, _, y in rows if not y)

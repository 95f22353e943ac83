"""The registered ``opN_`` queries over their whole tables: against their SQL, and against plain versions where SQL has none."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from oracle import connection, rows

from bayesloom.llm import personal, queries


def pandas_table(sf, name):
    import pandas as pd

    return pd.read_parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    import pandas as pd

    frame = queries.queries()[name](spark, sf)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    answer = connection(sf).execute(queries.oracle_sql()[name])
    want = pd.DataFrame(answer.fetchall(), columns=[c[0] for c in answer.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_token_counts_equal_greedy_matching(spark, sf):
    """Longest piece first, word by word, over every row of the table."""
    import json

    vocabulary = set(json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))["model"]["vocab"])
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    later = iter(range(256, 512))
    sign = {b: chr(b) if b in own else chr(next(later)) for b in range(256)}
    known = {}

    def pieces(word):
        if word not in known:
            signs, at, n = [*[sign[b] for b in word], "</w>"], 0, 0
            while at < len(signs):
                hit = next((j for j in range(len(signs), at, -1) if (p := "".join(signs[at:j])) in vocabulary and p != "</w>"), None)
                if hit is None:
                    n = -1
                    break
                at, n = hit, n + 1
            known[word] = n
        return known[word]

    docs = pandas_table(sf, "documents").set_index("doc_id").text
    for r in queries.op1_token_counts(spark, sf).collect():
        counts = [pieces(w) for w in (docs[r.doc_id] or "").encode().lower().split()]
        assert (r.n_words, r.n_unknown, r.n_tokens) == (len(counts), counts.count(-1), sum(max(c, 1) for c in counts))


def test_odd_conversation(spark, sf):
    odd = "\\### Assistant: </turn> ok"
    r = queries.op2_chat_formatting(spark, sf).where("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars) == (2, len(odd))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()


def test_toxicity_of_the_table(spark, sf):
    got = queries.op4_toxicity(spark, sf).toPandas()
    labels = pandas_table(sf, "labels").set_index("doc_id").toxic
    assert len(got) == len(pandas_table(sf, "documents")) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    import zlib

    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert set(got.predicted) <= {0, 1} and labels.notna().all()


def test_neighbours_of_the_table(spark, sf):
    got = queries.op5_approximate_neighbours(spark, sf).toPandas()
    e = pandas_table(sf, "embeddings")
    x, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1))
        assert g.score.to_numpy() == pytest.approx([d[ids == v][0] for v in g.vec_id], abs=1e-12)
        hits += len(set(ids[best]) & set(g.vec_id))
    assert hits / (10 * got.query_id.nunique()) >= 0.9


def test_packing_of_the_table(spark, sf):
    got = queries.op6_best_fit_packing(spark, sf).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    assert (got.groupby("doc_id").piece.max() + 1 == got.groupby("doc_id").piece.count()).all()
    assert set(got.doc_id) == set(pandas_table(sf, "documents").doc_id)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_pages_of_the_table(spark, sf):
    got = queries.op7_html_extraction(spark, sf).toPandas()
    assert len(got) == len(pandas_table(sf, "pages")) and (got.n_chars == got.text.str.len()).all()


def test_mix_of_the_table(spark, sf):
    got = queries.op8_source_mixing(spark, sf).toPandas().set_index("doc_id").sort_index()
    docs = pandas_table(sf, "documents").set_index("doc_id").sort_index()
    size = docs.text.fillna("").map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (got["size"] == size).all() and (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for s, g in got.join(docs.source).groupby("source"):
        assert g.source_size.iloc[0] == size[docs.source == s].sum()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.02 * g.target.iloc[0] + g["size"].max()


def test_personal_data_of_the_table(spark, sf):
    from test_text_operators import plain_spans

    docs = pandas_table(sf, "documents").set_index("doc_id").text
    for r in queries.op10_personal_data(spark, sf).collect():
        base = plain_spans(docs[r.doc_id] or "")
        n = Counter(k for *_, k in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in personal.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for s, e, k in base} <= set(r.spans.split(",")) | {""}
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) >= len(base)

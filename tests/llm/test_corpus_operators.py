"""Near duplicates, toxicity, searches, mixing and the pipeline, against brute force and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayesloom.llm import minhash, mixing, queries, search, toxicity


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, n, words, change):
    """Copies of one text, each changed in a few places, so that similarities lie around the threshold."""
    base = [f"w{rng.randint(0, 999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, change)):
            t[rng.randrange(words)] = f"z{rng.randint(0, 99_999)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rng = random.Random(width)
    texts = [None, "", "  ", "One", "one", "a b c", "A B c d e f", *family(rng, 60, 60, 6), *family(rng, 25, 30, 3), *family(rng, 10, 400, 20)]
    texts += ["same text here now"] * 20 + ["x " * 30_000]
    rows = list(enumerate(texts, start=10))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in [*rows, (None, "lost")]], "doc_id long, text string, n int, kept string")
    got = minhash.near_duplicates(df, width).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert minhash.near_duplicates(df.limit(0), width).count() == 0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, 2).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400, x) for x in range(401, 450)]
    root = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.comp for r in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_bin_collisions_estimate_similarity():
    rng = np.random.default_rng(0)
    for size in (4, 40, 400):
        same = 0.0
        for _ in range(60):
            s = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
            a, b = np.sort(s[: int(1.5 * size)]), np.sort(s[size // 2 :])
            sig = minhash.one_permutation(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2, 240)
            same += (sig[0] == sig[1]).mean() / 60
        assert same == pytest.approx(0.5, abs=0.08)


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    said = lambda k: " ".join(rng.choice(["ba", "ke", "lo", "mi"]) + rng.choice(["no", "ra", "ti", "su"]) + rng.choice(["", "s", "ly"]) for _ in range(k))
    rows, labels = [(None, "nothing", 1), (5, None, 1), (6, "", 1)], [(5, 0, 1), (6, 1, 0), (None, 1, 1)]
    for i in range(10, 900):
        bad = i % 4 == 0
        text = said(rng.randint(5, 60)) + (f" grumpf{rng.choice(['ing', 'ed', 'er', 'est'])} " + said(4) if bad else "")
        rows.append((i, text, 1))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id >= 10)]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.97
    assert toxicity.toxicity(docs.limit(0), known).count() == 0
    assert set(toxicity.toxicity(docs, known.limit(0)).select("score").distinct().collect()[0]) == {0.0}


def rare_expressions(spark):
    rng = random.Random(4)
    said = lambda k: " ".join(rng.choice(["ba", "ke", "lo", "mi"]) + rng.choice(["no", "ra", "ti", "su"]) for _ in range(k))
    rare = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(40)]
    rows = [(i, f"{said(9)} {rare[i // 4 % 40] if i % 4 == 0 else said(1)} {said(9)}") for i in range(2400)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(2400)], "doc_id long, quality int, toxic int")


def test_toxicity_counts_all_labels(spark):
    """A small calibration sample leaves the counts whole: expressions of other labelled texts are known, joined or broadcast."""
    docs, known = rare_expressions(spark)
    got = toxicity.toxicity(docs, known, per_class=12).toPandas()
    held = got[got.held_out]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.97
    n = toxicity.gram_counts(docs, known).agg(F.sum(F.expr("n0 + n1 + n2 + n3"))).first()[0]
    trained = docs.where(~toxicity.is_held_out())
    assert n == sum(len(w) + 1 for r in trained.collect() for w in r.text.split())
    joined = toxicity.scored(docs, toxicity.fit(docs, known, per_class=12, most=0)).toPandas().sort_values("doc_id")
    assert np.allclose(joined.score, got.sort_values("doc_id").score, atol=1e-9)


def plain_kneser_ney(texts, order, crossing, discount, strength):
    """Probabilities of the two class models by their definition, from dictionaries of grams."""
    from collections import Counter, defaultdict

    def grams(text):
        b = b" " + b" ".join(text.encode().lower().split()) + b" "
        for i in range(1, len(b)):
            back = i - b.rindex(b" ", 0, i)
            yield b[max(0, i - min(order - 1, back if back > crossing else i)) : i + 1]

    cells = [Counter(g for t, y in texts if y == c for g in grams(t)) for c in (0, 1)]
    every = {g for t, _ in texts for g in grams(t)}
    shorter = {g[k:] for g in every for k in range(1, len(g))}
    known, after = defaultdict(Counter), Counter(g[1:] for g in {*every, *(g for g in shorter if len(g) > 1)})
    for g in shorter:
        known[g[:-1]][g] = after[g]

    def shared(g):
        own = known[g[:-1]]
        return (max(own[g] - discount, 0) + discount * len(own) * (shared(g[1:]) if len(g) > 1 else 1 / 256)) / sum(own.values())

    def likelihood(g, y):
        own = {h: n for h, n in cells[y].items() if h[:-1] == g[:-1] and len(h) == len(g)}
        return (max(cells[y][g] - discount, 0) + (strength + discount * len(own)) * shared(g[1:])) / (strength + sum(own.values()))

    return every, likelihood


def test_toxicity_equals_plain_kneser_ney(spark):
    rng = random.Random(3)
    texts = [(" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 9))), i % 3 == 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(i, 1, int(y)) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")
    trained = {r.doc_id for r in docs.where(~toxicity.is_held_out()).collect()}
    every, likelihood = plain_kneser_ney([(t, int(y) if i in trained else None) for i, (t, y) in enumerate(texts)], toxicity.ORDER, toxicity.CROSSING, toxicity.DISCOUNT, toxicity.STRENGTH)
    got = {r.gram & (1 << 48) - 1: r.whole for r in toxicity.gram_evidence(toxicity.gram_counts(docs, known)).collect()}
    assert any(b" " in g[1:-1] for g in every)  # grams of more than one word
    assert len(got) > 50
    for g in every:
        want = np.log(likelihood(g, 1) / likelihood(g, 0))
        assert got.get(int.from_bytes(g, "big"), 0.0) == pytest.approx(want, abs=1e-9 if abs(want) >= toxicity.SILENT else toxicity.SILENT)


def test_passages_of_long_texts_cross_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    text = b" ".join(bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)) for _ in range(400))
    grams = np.unique(np.concatenate(list(toxicity.text_grams(text))))
    table = toxicity.Table(grams, rng.normal(size=len(grams)).astype(np.float32))
    whole = toxicity.text_features(text, table)
    e = table(np.concatenate(list(toxicity.text_grams(text)))).astype(float)
    assert whole == pytest.approx([e.mean(), *[max(e[i : i + w].mean() for i in range(len(e) - w + 1)) for w in toxicity.PASSAGES]], abs=1e-5)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert toxicity.text_features(text, table) == pytest.approx(whole, abs=1e-5)
    assert toxicity.text_features(b"", table) == [0.0] * 3 and len(toxicity.text_features(b"a", table)) == 3


def test_length_normalised_whole_texts_tell_classes_apart(spark):
    """The comparison over whole texts alone, where every word is of its class."""
    rng = random.Random(8)
    said = [lambda: rng.choice("bdg") + rng.choice("aeo") + rng.choice("nrl"), lambda: rng.choice("bdg") + rng.choice("aiu") + rng.choice("nst")]
    docs = spark.createDataFrame([(i, " ".join(said[i % 2]() for _ in range(rng.randint(3, 40)))) for i in range(600)], "doc_id long, text string")
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.with_features(docs, toxicity.fit(docs, known).evidence, "whole").where(toxicity.is_held_out()).toPandas()
    assert ((got._of_all > 0) == (got.doc_id % 2 == 1)).mean() > 0.97


def test_toxicity_cap_keeps_the_prior(spark):
    """Texts that say nothing of their class: the mean score is the share of toxic labels, whatever the cap."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["bano", "kera", "loti", "misu"]) for _ in range(12))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(1500)], "doc_id long, quality int, toxic int")
    whole, capped = (toxicity.toxicity(docs, known, per_class=n).agg(F.avg("score")).first()[0] for n in (3000, 100))
    assert abs(whole - 0.1) < 0.06 and abs(capped - whole) < 0.06


def vectors(spark, n=700, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).round(2)
    x[50:90] = x[50]  # copies
    rows = [(i, v.tolist(), 0.5) for i, v in enumerate(x)] + [(5000, None, 0.0), (5050, [0.0] * dims, 0.0), (5100, [float("nan")] * dims, 0.0), (5150, [None] * dims, 0.0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def test_exact_top_k(spark):
    x, df = vectors(spark)
    x = np.vstack((x, np.zeros((1, 8))))
    ids = np.array([*range(700), 5050])
    whole = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64)
    got = {}
    for r in search.exact_top_k(df, 50, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for q, found in got.items():
        s = whole @ whole[ids == q][0]
        best = [int(j) for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        assert sorted(found) == [(k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(best)]
    assert search.exact_top_k(df.limit(0), 50, 5).count() == 0


def test_neighbours(spark):
    x, df = vectors(spark, dims=16)
    x = x.astype(np.float32).astype(float)
    hits = total = 0
    got = {}
    for r in search.nearest_neighbours(df, 50, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 50))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [int(j) for j in np.lexsort((np.arange(700), d)) if j != q][:10]
        assert [s for *_, s in sorted(found)] == pytest.approx([d[v] for _, v, _ in sorted(found)])
        hits, total = hits + len({v for _, v, _ in found} & set(best)), total + 10
    assert hits / total >= 0.9
    few = search.nearest_neighbours(df.where("vec_id in (0, 50, 51)"), 50, 10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few if r.query_id == 50)[0] == (50, 1, 51)


def test_chi_square_quantile():
    assert search.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert search.chi_square_quantile(0.95, 16) == pytest.approx(26.296, abs=1e-3)


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "c", "c", "c", "Z", None]), " ".join(["w"] * rng.choice([0, 1, 5, 20, 60]))) for i in range(4000)] + [(None, "a", "x y"), (7, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x"))
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    assert (got["copies"] <= 2).all() and (got.loc[got["size"] == 0, "copies"] == 0).all()
    order = sorted({s for _, s, _ in rows if s}) + [None]
    size = {s: sum(len((t or "").split()) for _, q, t in rows if q == s) for s in order}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, capped = {}, 1.5 * sum(size.values()), set()
    while True:
        level = (left - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    target = {s: 2 * size[s] if s in capped else level * weight[s] for s in order}
    for s, g in got.assign(source=got["source"].astype(object).where(got["source"].notna(), None)).groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert g["target"].iloc[0] == pytest.approx(target[s])
        assert abs((g["copies"] * g["size"]).sum() - target[s]) <= 60
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "copies"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_rows_that_cannot_be_told_apart(spark):
    """A third of all rows of one null id and size: no chunk holds them, and their copies add up."""
    hot = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit("x y z").alias("text"))
    rest = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 20).cast("int")).alias("text"))
    got = mixing.mix(hot.union(rest))
    assert got.count() == 80_000
    for r in got.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("most")).collect():
        assert abs(r.taken - r.target) <= 40 and r.most <= 2
    same = got.where("doc_id is null").groupBy("source", "copies").count().collect()
    again = mixing.mix(hot.repartition(5).union(rest)).where("doc_id is null").groupBy("source", "copies").count().collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, again))


def test_one_large_family_is_not_copied_to_every_block(spark):
    """20,000 near copies, nearly all of one component: a member goes to about one group, whatever the family's size."""
    n = 20_000
    members = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"), F.when(F.col("id") % 200 == 0, F.col("id")).otherwise(1).alias("comp"))
    assert minhash._tiles(members).count() < 1.2 * n
    apart = minhash._tiles(members.withColumn("comp", F.col("node")).where("node < 1500"), block=100)
    met = apart.groupBy("x", "kind", "i", "j").agg(F.collect_list(F.struct("node", "home", "left")).alias("m")).collect()
    seen = set()
    for g in met:
        for a in g.m:
            for b in g.m:
                if a.node < b.node and (g.kind == -1 or (g.kind == 0 and a.home != b.home) or (g.kind == 1 and (g.i == g.j or a.left != b.left))):
                    seen.add((a.node, b.node))
    assert len(seen) == 1500 * 1499 // 2


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash._tiles, "__defaults__", (8,))
    rng = random.Random(12)
    rows = list(enumerate([*family(rng, 150, 40, 7), *family(rng, 60, 25, 4)]))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2)


def test_pipeline_stages_tell_rows_of_one_id_apart(spark, sf):
    """Null and repeated ids: no row is lost by the id of another."""
    import corpus_pipeline

    one, two = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (2, one, "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (None, None, "en", "s", 1), (None, "", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(map(str, [one, two, "a b c d e f g", None, ""]))
    mixed = corpus_pipeline.mix_sources(spark, kept, sf)
    assert {r.text for r in mixed.collect()} <= {one, two, "a b c d e f g"} and mixed.columns == docs.columns
    assert 24 <= sum(len(r.text.split()) for r in mixed.collect()) <= 48


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/{name}")
        at = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/{name}")
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    everyone = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert kept[0] == set(everyone) - toxic
    groups = brute([(i, everyone[i]) for i in kept[0]], 5)
    assert kept[1] == {i for i, (_, c) in groups.items() if i == c}
    assert kept[2] == kept[1] and kept[4] == kept[3] <= kept[2]


def test_every_query_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))

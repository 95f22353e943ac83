"""Spelling variants, whitening and URL filters against plain versions of the same."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bayesloom.llm import queries, urls, variants, whitening

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, modulus=97):
    found = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def as_rows(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_variants_equal_brute_force(spark):
    """Short alphabets make repeated letters, ties and many keys in common; accents make code points of two bytes."""
    rng = random.Random(3)
    stems = ["".join(rng.choices("aabé", k=rng.randint(4, 9))) for _ in range(60)]
    texts = []
    for _ in range(120):
        words = []
        for s in rng.choices(stems, k=40):
            i, kind = rng.randrange(len(s) + 1), rng.random()
            words.append(s if kind < 0.6 else s[:i] + rng.choice("abé") + s[i:] if kind < 0.8 else s[:i] + s[i + 1 :])
        texts.append(" ".join(words))
    rows = [(i // 2, t, "x", 5) for i, t in enumerate(texts)] + [(None, texts[0], "y", 6), (3, None, None, None), (4, "", "", 0), (5, "É×÷ 12 " * 3, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    words = plain_words([r[:2] for r in rows], 7)
    assert len(words) > 150
    assert as_rows(variants.spelling_variants(variants.vocabulary(docs, 7))) == plain_variants(words)


def test_every_single_edit_is_found_once(spark):
    """All edits of a few words, of every length parity and with runs of one letter."""
    words = {"aaaaa", "aaaaaa", "abcde", "abcdef", "abababab", "ééééééééé"}
    for w in list(words):
        for i in range(len(w) + 1):
            words |= {w[:i] + c + w[i:] for c in "aéz"} | {w[:i] + c + w[i + 1 :] for c in "aéz" if i < len(w)} | ({w[:i] + w[i + 1 :]} if len(w) > 5 else set())
    table = spark.createDataFrame([(w, 3 + len(w)) for w in words], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in variants.near_pairs(table).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_chain_of_forms_ends_at_its_root(spark):
    words = [("".join(["q"] * (20 - i)) + "abcdefghijklmnopqrst"[:i], 3 * 2**i) for i in range(20)]
    got = {r.word: r.root for r in variants.spelling_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    plain = {r[0]: r[2] for r in plain_variants(dict(words))}
    assert got == plain


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(variants.vocabulary(docs)).count() == 0


# whitening
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, 1.0) for i, v in rows], "vec_id long, embedding array<float>, component int, n double")


def plain_whitening(x):
    u = np.unique(x, axis=0)
    c = (u - u.mean(axis=0)).T @ (u - u.mean(axis=0)) / len(u)
    e, v = np.linalg.eigh(c)
    return u, e[::-1], v[:, ::-1], np.trace(c)


def test_whitening_of_the_table(spark, sf):
    got = queries.op12_embedding_whitening(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(256 * np.array(table.embedding.tolist(), float))
    u, e, v, trace = plain_whitening(x)
    assert len(got) == 4 * len(table) and (got.n == len(u)).all() and got.identity_error.max() < 1e-9
    deviation = [sum((len(u) * int(a) - int(s)) ** 2 for a, s in zip(r, u.sum(axis=0), strict=True)) for r in x]
    for c, g in got.groupby("component"):
        g = g.sort_values("vec_id")
        want = (x - u.mean(axis=0)) @ v[:, c - 1] / np.sqrt(e[c - 1])
        sign = np.sign(want @ g.whitened)
        assert g.whitened.to_numpy() * sign == pytest.approx(want, abs=1e-8)
        assert g.deviation.tolist() == deviation
        assert g.explained.to_numpy() == pytest.approx(e[c - 1] / trace, rel=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(a) for a in rng.standard_normal(6) * [9, 7, 5, 3, 2, 1]]) for i in range(200)]
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [float("nan")] + [0.0] * 5), (904, [float("inf")] + [0.0] * 5), (905, [None] + [1.0] * 5)]
    rows = [*good, *odd, (None, good[0][1]), (5, good[5][1]), (5, good[6][1])]
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    assert len(got) == 4 * 203 and (got.n == 200).all()
    x = np.floor(256 * np.array([np.float32(v) for _, v in good], float))
    _, e, v, _ = plain_whitening(x)
    first = got[(got.component == 1) & got.vec_id.isin([i for i, _ in good if i != 5])].sort_values("vec_id")
    want = ((x - x.mean(axis=0)) @ v[:, 0] / np.sqrt(e[0]))[[i for i in range(200) if i != 5]]
    assert np.abs(first.whitened.to_numpy() * np.sign(want @ first.whitened.to_numpy())) == pytest.approx(np.abs(want), abs=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whitened(vectors(spark, rows)).count() == 0


def test_one_varying_dimension_gives_one_component(spark):
    got = whitening.whitened(vectors(spark, [(i, [1.0, float(i), 2.0]) for i in range(5)])).toPandas()
    assert len(got) == 5 and set(got.component) == {1} and got.explained.to_numpy() == pytest.approx(1.0)


def test_filtered_iteration_equals_a_dense_solver():
    """Spectra with close leading values, a heavy tail, and equal values."""
    rng = np.random.default_rng(0)
    for spectrum in (np.linspace(2, 1, 150), 1 / np.arange(1, 151) ** 2, np.r_[50, 49.9, 49.8, np.ones(147)], np.r_[np.full(3, 5.0), np.linspace(1, 0, 147)]):
        q = np.linalg.qr(rng.standard_normal((150, 150)))[0]
        a = q * spectrum @ q.T
        passes = []
        found, values, residual = whitening.components(lambda y, a=a, p=passes: p.append(1) or a @ y, 150, 4, np.trace(a))
        assert values == pytest.approx(spectrum[:4], rel=1e-10) and residual < 1e-11
        assert found.T @ found == pytest.approx(np.eye(4), abs=1e-10) and len(passes) < 150


# urls
RULES = queries.URL_RULES


def test_hosts_paths_and_rules(spark):
    cases = {
        "https://WWW.Example.com/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/"),
        "http://badexample.com/en/2": ("badexample.com", "/en/2", "com/"),
        "http://x.net/es": ("x.net", "/es", None),
        "http://x.net/es/": ("x.net", "/es/", "net/es/"),
        "http://com": ("com", "", None),
        "http://x.org:80/a?b=/net/es/": ("x.org:80", "/a", None),
        "http://h.net?u=http://y.com/": ("h.net", "", None),
        "ftp://h.net#/fr/": ("h.net", "", None),
        "a://b://c/d": ("b:", "//c/d", None),
        "://": ("", "", None),
        "no scheme.com/": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "http://É.com/\nen": ("É.com", "/\nen", "com/"),
    }
    rows = [(i, u, "keep", True) for i, u in enumerate(cases)] + [(None, "http://x.net/fr/1", None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, blocked boolean")
    none = urls.fit(spark.createDataFrame([], "url string, bad boolean"))
    got = urls.judge(pages, RULES, none).collect()
    assert len(got) == len(rows)
    verdict = {r: v for v, r in RULES}
    for r in got:
        want = cases.get(r.url, ("x.net", "/fr/1", "net/fr/"))
        assert (r.host, r.path, r.rule) == want and r.verdict == verdict.get(r.rule, "allow")


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "x.y.example.com:8080": ("com", "example.com"), "localhost": ("localhost", "localhost"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "": ("", "")}
    got = urls.with_domain(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    assert {r.host: (r.suffix, r.domain) for r in got} == hosts


def plain_strength(groups):
    over = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in groups)
    most = sum(n * (n - 1) * m * (1 - m) for n, k, m in groups)
    return 1 / min(max(over / most, 1e-4), 1 - 1e-4) - 1 if most else 1 / 1e-4 - 1


def test_reputation_equals_a_plain_version(spark):
    """Hosts of one bad domain, one of clean ones, hosts of few pages and hosts never labelled."""
    rng = random.Random(2)
    outcomes = []
    for d in range(12):
        rate = 0.95 if d % 4 == 0 else 0.03
        for h in range(8):
            outcomes += [(f"http://h{h}.d{d}.{'org' if d % 2 else 'net'}/{i}", rng.random() < rate) for i in range(rng.choice((1, 4, 40)))]
    outcomes += [("http://h0.d1.org/x", None), (None, True)]
    fitted = urls.fit(spark.createDataFrame(outcomes, "url string, bad boolean"))
    counts = {}
    for u, bad in outcomes:
        if bad is not None:
            host = u.split("/")[2] if u else ""
            n, k = counts.get(host, (0, 0))
            counts[host] = (n + 1, k + bad)
    up = lambda h: ".".join(h.split(".")[-2:])

    def grouped(of, by):
        out = {}
        for key, (n, k) in of.items():
            a, b = out.get(by(key), (0, 0))
            out[by(key)] = (a + n, b + k)
        return out

    domains = grouped(counts, up)
    suffixes = grouped(domains, lambda d: d.split(".")[-1])
    total = grouped(suffixes, lambda s: 0)[0]
    m0 = (total[1] + 1) / (total[0] + 2)
    c = plain_strength([(n, k, m0) for n, k in suffixes.values()])
    ms = {s: (c * m0 + k) / (c + n) for s, (n, k) in suffixes.items()}
    c = plain_strength([(n, k, ms[d.split(".")[-1]]) for d, (n, k) in domains.items()])
    md = {d: (c * ms[d.split(".")[-1]] + k) / (c + n) for d, (n, k) in domains.items()}
    c = plain_strength([(n, k, md[up(h)]) for h, (n, k) in counts.items()])
    hosts = [*counts, "new.d4.net", "new.d5.org", "a.other.org", "b.elsewhere.io"]
    got = {r.host: r for r in urls.host_verdicts(spark.createDataFrame([(h,) for h in hosts], "host string"), fitted).collect()}
    assert set(got) == set(hosts)
    for h, r in got.items():
        n, k = counts.get(h, (0, 0))
        prior = md.get(up(h), ms.get(h.split(".")[-1], m0))
        rate = (c * prior + k) / (c + n)
        assert (r.n_labelled, r.n_bad) == (n, k) and r.bad_rate == pytest.approx(rate, abs=1e-9)
        assert r.bound == pytest.approx(rate - 1.645 * (rate * (1 - rate) / (c + n + 1)) ** 0.5, abs=1e-9)
        assert r.blocked == (r.bound > 0.5)
    assert got["new.d4.net"].blocked and not got["new.d5.org"].blocked and not got["b.elsewhere.io"].blocked


def test_url_filter_is_native(spark, sf):
    plan = queries.op13_url_filters(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

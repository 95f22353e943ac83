"""Token counts, chat formatting, packing, personal data and page text against plain versions of the same."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bayesloom.llm import chat, html, packing, personal, tokencount
from bayesloom.llm.tokens import WordIds

ODD = [None, "", "   ", "a", "A.,B ÀÉ. ª º µ ÿ", "it's we'll don't 12a3", "<|endoftext|>a", "İstanbul ΣΑΣ ﬁ 中文字", "x" * 70_000, "é ábc.\x0b x\x1cz\x85q"]


def docs(spark, texts=ODD):
    """Rows with repeated ids, a null id, and extra columns of clashing names."""
    rows = [(i // 2 if i else None, t, "n", 7, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n int, sequence_id string")


def test_longest_match_counts():
    rng = random.Random(5)

    def naive(pieces, s):
        n = i = 0
        while i < len(s):
            j = next((j for j in range(len(s), i, -1) if s[i:j] in pieces), None)
            if j is None:
                return -1
            i, n = j, n + 1
        return n

    for _ in range(400):
        pieces = {tuple(rng.choices((1, 2, 3), k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = tokencount.Automaton(list(pieces))
        for _ in range(10):
            s = tuple(rng.choices((1, 2, 3), k=rng.randint(0, 12)))
            assert automaton.count(s) == naive(pieces, s)


def test_token_counts_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = tokencount.token_counts(docs(spark), path).collect()
    assert len(got) == len(ODD)
    assert [r.n_tokens for r in got][:3] == [0, 0, 0]
    assert tokencount.token_counts(docs(spark).limit(0), path).count() == 0


def test_word_ids_equal_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, ours = Tokenizer.from_file(path), WordIds(path)
    texts = [t for t in ODD if t] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert np.frombuffer(ours(t.encode()), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs(spark).select("doc_id", "text"))
    got = packing.pack_documents(source, path, capacity=512).toPandas()
    ours = WordIds(path)
    want = []
    for r in source.collect():
        ids = ours((r.text or "").encode()) + b"\x01\0\0\0"
        want += [(r.doc_id, k // 2048, k // 4, len(ids[k : k + 2048]) // 4, zlib.crc32(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    key = lambda t: tuple(-1 if x is None or x != x else int(x) for x in t)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(map(key, want))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) + 2


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    search = packing.Search(lengths, np.arange(8), 10)
    where = search.run()
    assert np.bincount(where, lengths).max() <= 10
    assert (search.fill > 0).sum() == 3 and search.emptied == 5 and search.steps["move"]


def test_the_search_and_not_the_start_reaches_the_fewest_bins():
    """First fit leaves more bins than possible; moves and all three exchanges take them away."""
    lengths = np.random.default_rng(5).gamma(2.0, 500.0, 3000).astype(int).clip(1, 4096)
    start = packing.first_fit(lengths, 4096)
    fewest = -(-lengths.sum() // 4096)
    assert len(set(start.tolist())) > fewest
    search = packing.searched(lengths, 4096)
    assert (search.fill > 0).sum() == fewest and search.emptied == len(set(start.tolist())) - fewest
    assert min(search.steps.values()) > 0 and sum(search.steps.values()) > 100


def test_squared_fill_grows_with_each_step():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 80)
    search = packing.Search(lengths, packing.first_fit(lengths, 100), 100)
    search._pairs()
    for a in range(len(search.fill)):
        before = (search.fill**2).sum()
        if search.fill[a] and search.step(a):
            assert (search.fill**2).sum() > before
            assert (np.bincount(search.where, lengths, len(search.fill)) == search.fill).all() and search.fill.max() <= 100
            assert all(sorted(np.flatnonzero(search.where == b)) == sorted(m) for b, m in enumerate(search.members))


def test_many_equal_pieces_in_a_bin():
    where, offset, total = packing.pack_group(np.ones(20_000, np.int64), 4096)
    assert len(set(where.tolist())) == 5 and total.max() == 4096 and len({*zip(where.tolist(), offset.tolist())}) == 20_000


def test_many_groups(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("length"))
    got = packing.pack(rows, capacity=100, group=500).toPandas()
    assert len(got) == 3000
    assert got.groupby("sequence_id").length.sum().max() <= 100
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 100 + 1


def test_pieces_that_fill_no_bin(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(60).cast("long").alias("length"))
    got = packing.pack(rows, capacity=100, group=500).toPandas()
    assert len(got) == got.doc_id.nunique() == got.sequence_id.nunique() == 3000
    assert (got.offset == 0).all()


def test_chat_round_trip(spark):
    odd = ["", "###", "####", "\\", "\\\\###", "a\\", "</turn>", "\n</turn>\n", "\\</turn>\\", "### User: x\n</turn>\n### Assistant: y", "\\####\\###", "$1", "🙂 ###é"]
    rows = [(i, k, role, t) for i, t in enumerate(odd) for k, role in enumerate(["user", "assistant", "we: ird ###", None])]
    rows += [(99, 0, "assistant", None), (99, 0, "assistant", None), (None, 1, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("begin", F.lit("x"))
    done = chat.format_conversations(turns)
    for r in done.select("conv_id", chat.parse(F.col("formatted")).alias("t"), "formatted", "mask").collect():
        want = [(role or "", t or "") for c, _, role, t in rows if c == r.conv_id]
        assert [tuple(x) for x in r.t] == want
    for r in chat.read_back(done).collect():
        said = [(role or "", t or "") for c, _, role, t in rows if c == r.conv_id]
        loss = "".join(t for role, t in said if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def plain_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and personal.luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], personal.KINDS.index(s[2])))


def test_base_spans():
    rng = random.Random(3)
    parts = ["a", "1", "22", "255", "256", ".", "@", " ", "-", "+", "(", ")", "4111111111111111", "%", "é", "x@y.z", "٣"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert personal.base_spans(t) == plain_spans(t)
    assert personal.base_spans("9" * 200_000) == [] and personal.base_spans("a" * 200_000) == []


def test_personal_data_rows(spark):
    texts = [None, "", "call +1 (988) 555-2485 now", "password=b7db7aa4a5fcc78305 a@b.co", "version 12345678 of it", "token = \"0641917ea4e9feb9cda83477b57ac265\""] * 3
    d = docs(spark, texts)
    weights = personal.fit(d)
    rows = personal.find_spans(d, weights).collect()
    assert len(rows) == len(texts)
    kinds = [[s.kind for s in r.spans] for r in rows[:6]]
    assert kinds == [[], [], ["phone"], ["secret", "email"], [], ["secret"]]
    clean = [r.text for r in personal.redact(d, weights).collect()]
    assert clean[0] is None and clean[3] == "password=<SECRET> <EMAIL>"
    assert personal.redact(d, weights).columns == d.columns
    empty = personal.fit(d.limit(0))
    assert personal.find_spans(d.limit(0), empty).count() == 0


def test_em_finds_the_unreliable_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth else -1) if rng.random() < a else (-1 if truth else 1) for a in (0.95, 0.9, 0.5))
        key = (rng.choice("ab"), votes)
        counts[key] = counts.get(key, 0) + 1
    shares, rates, _ = personal.em(counts)
    assert rates[1, 0, 2] > 0.85 and rates[1, 1, 2] > 0.8 and abs(rates[1, 2, 2] - 0.5) < 0.12
    assert all(abs(x - 0.4) < 0.08 for x in shares.values())


def mixed_candidates(n=1500, seed=4):
    """Texts of every wider kind, true and false, and what is personal in them."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexed = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(4, 8)))

    def iban(good):
        body = digits(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{check if good else (check + 3) % 97:02d}{body}"

    kinds = {
        "secret": (lambda: (f"login {word()} password = ", f"{hexed(7)}Z{hexed(9)}9"), lambda: (f"{word()} {word()} code: ", rng.choice(["changeme", "xxxxxxx", "none", "aaaaaaaaaaaa"]))),
        "iban": (lambda: (f"account {word()} IBAN ", iban(True)), lambda: (f"order {word()} item ", iban(False))),
        "ssn": (lambda: (f"my ssn is ", f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"), lambda: (f"see page {word()} line ", f"000-{rng.randint(10, 99)}-0000")),
        "birth_date": (lambda: ("she was born on ", f"19{rng.randint(40, 99)}-{rng.randint(1, 9):02d}-{rng.randint(10, 28)}"), lambda: ("version of the release, updated and born again ", f"20{rng.randint(10, 25)}-{rng.randint(1, 9):02d}-{rng.randint(10, 28)}")),
        "person": (lambda: (f"{word()} contact Mr ", f"{rng.choice(['Peter', 'Anna', 'Hans'])} {word().capitalize()}"), lambda: ("published version of the ", f"{rng.choice(['Peter', 'Anna', 'Hans'])} {word().capitalize()}")),
        "address": (lambda: ("her home address is ", f"{rng.randint(1, 99)} {rng.choice(['Oak', 'King', 'Mill'])} Street"), lambda: ("figure of the home example ", f"{rng.randint(1, 99)} {word().capitalize()} {word().capitalize()}")),
    }
    out = []
    for _ in range(n):
        kind = rng.choice(list(kinds))
        true = rng.random() < 0.5
        before, span = kinds[kind][not true]()
        out.append((f"{before}{span} {word()} {word()}.", kind, len(before), len(before) + len(span), true))
    return out


def test_labelers_disagree_and_the_classifier_decides_within_kinds(spark):
    """Kinds with true and false candidates: neither all nor none of a kind is accepted, and labelers get different weights."""
    said = mixed_candidates()
    model = personal.fit(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(said)], "doc_id long, text string"))
    right, by_kind = [], {}
    for t, kind, start, end, true in mixed_candidates(seed=5):
        found = (start, end, kind) in personal.accepted(t, personal.base_spans(t), model)
        right.append(found == true)
        by_kind.setdefault(kind, []).append(found)
    assert np.mean(right) > 0.93
    assert all(0.2 < np.mean(x) < 0.8 for x in by_kind.values())
    assert all(0.1 < model.shares[k] < 0.9 for k in by_kind)
    gain = [model.rates[1, i, 2] - model.rates[0, i, 2] for i in range(len(personal.LABELERS))]
    assert max(gain) - min(gain) > 0.3  # some are believed more than others


def test_masked_addresses_in_any_form():
    for t in ("jo ( at ) site ( dot ) com", "jo[At]site[DOT]org", "jo [ at ] site [ dot ] de"):
        assert [c.kind for c in personal.candidates(t, [])] == ["masked_email"]


@pytest.fixture(scope="module")
def trees():
    return html.fit()


def test_main_text_of_pages(spark, sf, trees):
    """All pages of the table, against their article element's blocks."""
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages, trees).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1].replace("<br>", " ")
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_held_out_invented_pages(trees):
    rng, right, total = random.Random(99), 0, 0
    for _ in range(60):
        page = html.invented_page(rng)
        nodes = html.parse(page)
        said = np.array([1, *map(int, re.findall(r'<[a-z0-9]+[^>]*data-main="([01])"', page))], bool)
        kept = html.decode(nodes, trees.chance(html.features(nodes)))
        assert all(kept[n.parent] for n, k in zip(nodes[1:], kept[1:], strict=True) if k)
        right, total = right + (kept == said).sum(), total + len(nodes)
    assert right / total > 0.97


def test_positions_among_many_siblings():
    """The share of the way through the siblings, and whether a block is the first, in a parent of 500."""
    x = html.features(html.parse("<div>" + "<p>text</p>" * 500 + "</div>"))[2:]
    assert np.allclose(x[:, -3], np.arange(500) / 499) and x[:, -2].tolist() == [1.0] + [0.0] * 499


@pytest.mark.parametrize(
    "odd",
    ["<svg/>", "<svg width='1' />", "<button>drop", "<div><canvas>drop</div>", "<select><option>drop", "<svg><svg>drop</svg>drop</svg>", "<object><object>drop</object>drop</object>", "<button>drop<p></p><button>drop</button>"],
)
def test_unclosed_and_nested_elements(odd):
    said = " ".join(t.strip() for n in html.parse(f"<article>{odd}<p>one</p><p>two</p></article>") for _, t, _ in n.parts)
    assert said.split() == ["one", "two"]


@pytest.mark.parametrize(
    "page, text",
    [
        ("""<p title="it's">Don't stop reading now</p><p>b</p>""", "Don't stop reading now|b"),
        ("""<p><img alt="It's a dog"> I don't know</p>""", "I don't know"),
        ("""<p title='5"'>He said "hello there" ok</p>""", 'He said "hello there" ok'),
        ("""<p title="a<b>c">t</p>""", "t"),
        ("""<a href="foo>text</a><p class="x">more</p>""", "text|more"),
        ("""<p class=a/b id='c' =x>t</p>""", "t"),
        ("""<a name="x"/>one<p>two</p>""", "one|two"),
        ("""<a href=/x/>one</a><br/>two""", "one|two"),
        ("""a < b and c > d""", "a|<|b and c > d"),
    ],
)
def test_quotes_and_slashes_in_tags(page, text):
    assert [t.strip() for n in html.parse(page) for _, t, _ in n.parts if t.strip()] == text.split("|")


def test_links_end_where_they_are_closed():
    nodes = html.parse('<div><a href=/x/>in</a> out <a name="y"/>out</div>')
    assert [(t.strip(), link) for _, t, link in nodes[1].parts] == [("in", True), ("out", False), ("out", False)]


@pytest.mark.parametrize("page", ["<span>" * 50_000 + "</i>x" * 50_000, "<p>a</p>" * 100_000, "<span>" * 50_000 + "<p>x" * 50_000])
def test_many_tags_take_linear_time(page):
    began = time.perf_counter()
    html.parse(page)
    assert time.perf_counter() - began < 30


def test_a_page_of_many_megabytes(trees):
    said = [f"Paragraph {i} says something, at length, about the matter of the article." for i in range(40_000)]
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>" + "".join(f"<p>{t}</p>" for t in said) + "</article></body></html>"
    assert html.main_texts([page], trees)[0] == "\n".join(said)


def test_odd_pages(spark, trees):
    odd = [None, "", "plain &amp; <b>text</b>", "<!-- x", "<script>if(a<b)</script>", "<<a", "<p", "</p></div>", "<div>" * 300]
    df = spark.createDataFrame([(1, "u", h, "t") for h in odd], "page_id long, url string, html string, text string")
    got = [r.text for r in html.extract(df, trees).collect()]
    assert len(got) == len(odd) and got[:3] == ["", "", "plain & text"]
    assert html.extract(df.limit(0), trees).count() == 0

"""Spelling variants, whitening and page extraction against plain versions, and on odd inputs."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codexlake.llm import extraction, registry, variants, whitening

DIR = "/root/testdata/sf0.001"
LOW = str.maketrans(variants.UPPER, variants.LOWER)


def plain_variants(rows):
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 5
    n = {w: c for w, c in count.items() if c >= 3}
    groups, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w) + 1):
            groups[w[:k] + " " + w[k:]].add(w)
            groups[w[:k] + " " + w[k + 1 :]].add(w)
    for g in groups.values():
        for w in g:
            near[w] |= g - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got_variants(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_of_given_texts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert got_variants(variants.spelling_variants(docs)) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_variants_odd(spark):
    rng = random.Random(4)
    # letters at both ends of the range, words that differ at any place, long words, one letter repeated
    words = ["".join(rng.choice("abÿÀ") for _ in range(rng.choice([5, 6, 7]))) for _ in range(600)] + ["a" * k for k in range(5, 60)]
    long = "".join(rng.choice("xyz") for _ in range(3000))
    words += [long, long[:1500] + long[1501:], long[:-1] + "q", "q" + long]
    rows = [(k, " ".join(rng.sample(words, len(words)) + [rng.choice(words)] * 50)) for k in range(4)]
    rows += [rows[0], (None, "abcde abcde Abcde ABCDF abcdf abcdf abcdf"), (7, None), (8, ""), (9, "1234 é 中文 \U00013080")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("zzzzz").alias("TEXT"), F.lit(1).alias("n"), F.lit("x").alias("word"))
    assert got_variants(variants.spelling_variants(docs)) == plain_variants(rows)
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_large_groups_of_long_words_are_cut(spark, monkeypatch):
    monkeypatch.setattr(variants, "LONG_BLOCK", 16)
    rng = random.Random(9)
    words = sorted({"k" * 90 + "".join(rng.choice("abc") for _ in range(4)) for _ in range(80)})
    pairs = variants.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")).collect()
    want = {(a, b) for a, b in itertools.combinations(words, 2) if sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    assert len(pairs) == len(want) and {tuple(sorted((r.a, r.b))) for r in pairs} == want


def test_tiles_cover_each_pair_once():
    starts, ends = np.array([0, 3, 5, 90]), np.array([3, 5, 90, 300])
    seen = Counter()
    for a, b in variants.tiles(starts, ends, 300):
        for x, y in zip(a, b, strict=True):
            seen.update((p, q) for p in x for q in y if p < q < 300)
    assert seen == Counter((p, q) for lo, hi in zip(starts, ends, strict=True) for p, q in itertools.combinations(range(lo, hi), 2))


@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "deficient", "diagonal", "split"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_leading_eigenvectors(n, kind):
    rng = np.random.default_rng(n)
    m = rng.standard_normal((n, n))
    q = np.linalg.qr(m)[0]
    a = {"random": m @ m.T, "equal": 3 * np.eye(n), "clusters": (q * ([5.0] * min(3, n) + [1.0] * max(0, n - 3))) @ q.T, "deficient": m[:, :2] @ m[:, :2].T, "diagonal": np.diag(np.arange(n) + 0.0)}.get(kind)
    if a is None:
        a = np.zeros((n, n))
        a[: n // 2, : n // 2] = m[: n // 2, : n // 2] @ m[: n // 2, : n // 2].T
    a = (a + a.T) / 2
    values, vectors = whitening.leading(a)
    size = max(1.0, np.abs(a).max())
    exact = np.linalg.eigvalsh(a)[::-1]
    assert len(values) == min(4, (exact > 1e-9 * size).sum())
    assert np.allclose(values, exact[: len(values)], rtol=1e-12, atol=1e-12 * size)
    assert np.abs(a @ vectors.T - vectors.T * values).max(initial=0) < 1e-11 * size and np.abs(vectors @ vectors.T - np.eye(len(values))).max(initial=0) < 1e-12


def check_whitening(rows, got, dims):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, np.floor(256 * np.array(list(v) + [0.0] * (dims - len(v)))).astype(int)) for i, v in usable]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, s = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(dims, dims))
    values, vectors = values[::-1][:4], vectors[:, ::-1].T[:4]
    want = sorted((i, k + 1, n, int(((n * v - s) ** 2).sum()), round(abs(float((v - s / n) @ vectors[k] / values[k] ** 0.5)), 7)) for i, v in x for k in range(len(values)))
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 7)) for r in got) == want
    total = np.trace(np.cov(fit.T, bias=True).reshape(dims, dims))
    assert all(abs(r.explained - values[r.component - 1] / total) < 1e-9 and r.identity_error < 1e-9 for r in got)
    return len(want)


def test_whitening(spark):
    e = spark.read.parquet(f"{DIR}/embeddings.parquet")
    assert check_whitening([(r.vec_id, r.embedding) for r in e.collect()], whitening.op12_whitening(spark, DIR).collect(), 64)


def test_whitening_odd(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in rng.standard_normal(5)]) for k in range(40)]
    rows += [(1, rows[0][1]), (2, rows[0][1]), (50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [float("nan")] * 5), (53, [float("inf")] * 5), (54, [0.5, -0.5]), (55, []), (56, [-0.0] * 5)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("X", F.lit(1)).withColumn("n", F.lit("clash"))
    assert check_whitening(rows, whitening.whitened(e).collect(), 5) == 4 * 45
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert whitening.whitened(same).count() == 0 and whitening.whitened(e.limit(0)).count() == 0
    # one direction only: one component; sums of over 64 bits an error, not a wrong value
    line = whitening.whitened(spark.createDataFrame([(k, [k / 256, k / 128]) for k in range(9)], "vec_id bigint, embedding array<double>")).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    assert whitening.deviations(np.array([[3_000_000, 0]]), 500, [0, 0]) == [(500 * 3_000_000) ** 2]
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[1 << 40]]), 1 << 30, [0])


TEXT = ["The river rises in the hills above the town and runs south for two hundred miles before it meets the sea.", "Its waters drove mills from the twelfth century, and several of them still stand today.", "Short line.", "In 1870 a flood carried away three bridges; they were rebuilt in stone &amp; iron within five years."]
BODY = "".join(f"<p>{p}</p>" for p in TEXT)
MAIN = f"<h1>Title of it</h1>{BODY}"
WITHIN = """<div class=ad>Buy our boats now!</div><form><label>Mail</label><input><select><option>a<option>b</select></form><aside>More</aside><script>var a="<p>no</p>";</script><p>Short"""
PAGES = {
    "frame": f'<html><head><title>x</title></head><body class="has-sidebar home"><header><a href=/>Site</a> <p>The best site of all for rivers and more things.</p></header><nav><a>A</a></nav><div class="cookie-notice"><p>We use cookies to make this site better for all of our visitors.</p><button>OK</button></div><main>{MAIN}<div class="share-buttons">Share</div></main><aside><p>Another long text about mountains, which is not part of the article at all.</p></aside><section id="comments"><article class="comment"><p>I loved this text, it was really good to read.</p></article></section><footer>© 2024 Site.</footer></body></html>',
    "divs": f'<body><div id="header"><a>Home</a></div><div id="menu"><ul><li><a>One</a></li></ul></div><div id="content">{MAIN}</div><div id="sidebar"><p>Sign up for our weekly letter today, it is free.</p></div><div id="comments"><p>First comment here, with quite a few words in it.</p></div><div id="footer">Copyright 2020</div></body>',
    "bare": f"<body><div><a>Home</a> <a>News</a> <a>Sport</a></div><div>{MAIN}</div><div><a>Imprint</a> | <a>Contact</a></div></body>",
    "within": f'<article>{MAIN.replace("<p>Short", WITHIN)}<footer>Tags</footer></article>',
    "open": f'<nav><ul><li><a>x</a><div class="ad">spam spam<article><h1>Title of it<p>{"<p>".join(TEXT)}',
    "inline": f'<article class="post comments-open">{MAIN.replace("Title", "Ti<b>tl</b>e").replace("river", "<a href=x>river</a>").replace("Short", "<span class=ad>Buy</span><!-- no --> Short&nbsp;")}</article>',
    "roles": f'<div role="banner">Name of site</div><div role=navigation><a>x</a></div><section class="article-body">{MAIN}</section><div role="complementary">Other things to read on this site.</div><div style="display: none">Hidden words here.</div>',
    "upper": f"<BODY><NAV><A HREF=x>x</A></NAV><ARTICLE>{MAIN}</ARTICLE><FOOTER>end of page.</FOOTER>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_extraction_of_layouts(name):
    assert extraction.main_text(PAGES[name]) == " ".join(["Title of it", *TEXT]).replace("&amp;", "&")


def test_minimum_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0.1, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def price(labels):
            return sum(abs(c) for c, x in zip(costs, labels, strict=True) if (c > 0) != x) + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert abs(price(extraction.minimum_cut(costs, edges)) - min(map(price, itertools.product([False, True], repeat=n)))) < 1e-9


def test_extraction_odd(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>x is here."), (2, "u", "no markup, only words."), (3, "u", "<p>x.</p>" * 20_000), (4, "u", "<div>" * 20_000 + "in the deep."), (5, "u", "<!-- never"), (6, "u", "<a title='open <p>x"), (7, "u", "é &#128512; &bogus; &amp")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("HTML_", F.lit(1)).withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.text) for r in extraction.extract(pages).collect()}
    assert {(1, ""), (None, "x is here."), (2, "no markup, only words."), (4, "in the deep."), (5, "")} <= got and len(got) == 8
    assert (3, " ".join(["x."] * 20_000)) in got
    assert extraction.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_variants", "op13_extraction"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = registry.queries()[name](spark, DIR)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())

"""Centroid clustering, HTML extraction and ranked search, against brute force and on odd inputs."""

import hashlib
import math
import pickle
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracles import TABLES
from vellum.llm import bitplanes, langid, quality, treap
from vellum.llm._folds import fold
from vellum.llm._store import Scratch
from vellum.llm.bitplanes import cluster, dots, from_planes, nearest, norms, to_planes
from vellum.llm.htmltext import extract, main_text, smoothed, threshold
from vellum.llm.permindex import nearest_neighbours

VECTORS = "vec_id long, embedding array<float>, cluster int, distance long, v string, planes string"


def vector_rows(rng, n):
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(n)]
    rows += [(3, rows[3][1]), (4, rows[9][1]), (None, rows[5][1])]  # a repeated row, a repeated id, no id
    rows += [(900, None), (901, [0.5] * 63), (902, [None] + [0.1] * 63), (903, [float("nan")] + [0.1] * 63), (904, [float("inf")] + [0.1] * 63)]
    return rows + [(950, [0.0] * 64), (951, [-3.0] * 64), (952, [700.5] + [0.0] * 63)]


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in np.array(v, np.float32).astype(float)]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    centers = [list(v) for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for n in range(len(centers)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == n]
            if own:
                centers[n] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    inertia = Counter()
    for far, c in at:
        inertia[c] += far
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted([(i, c, far, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (far, c) in zip(kept, at)], key=str)


def test_clusters_match_brute_force(spark):
    rows = vector_rows(random.Random(5), 90)
    table = spark.createDataFrame([(i, v, 1, 2, "x", "y") for i, v in rows], VECTORS).repartition(5)
    assert sorted(map(tuple, cluster(table, k=7, rounds=3).collect()), key=str) == brute_clusters(rows, 7, 3)
    few = table.where("vec_id < 3")
    assert {r["cluster"] for r in cluster(few).collect()} == {0, 1, 2}
    assert cluster(table.limit(0)).collect() == [] and cluster(table.where("vec_id = 901")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10**6))
def test_planes_give_products(bits, seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-(2**bits), 2**bits, (5, 64)) for _ in range(2))
    left, right = to_planes(a), to_planes(b)
    assert (from_planes(left) == a).all()
    exact = [[sum(int(x) * int(y) for x, y in zip(u, v)) for u in a] for v in b]
    assert [[int(x) for x in dots(left, v)] for v in right] == exact
    assert [int(x) for x in norms(left)] == [sum(int(x) ** 2 for x in u) for u in a]
    if bits < 20:
        far = ((a[:, None] - b[None]) ** 2).sum(2)
        at, best = nearest(left, right)
        assert at.tolist() == far.argmin(1).tolist() and best.tolist() == far.min(1).tolist()


def test_a_distance_beyond_64_bits_is_an_error():
    with pytest.raises(ArithmeticError):
        nearest(to_planes(np.full((1, 64), 2**40)), to_planes(np.full((1, 64), -(2**40))))


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega sigma lambda kappa".split()) for _ in range(n)).capitalize() + "."


MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>World</a></li><li><a href=/c>Sport</a></li></ul>"
#: Pages around ``%s``, the article's own markup.
FRAMES = {
    "article": "<html><head><title>T</title><style>p{}</style></head><body><nav>" + MENU + "</nav><article>%s</article><footer>Copyright us</footer></body></html>",
    "main": "<body><header><h1>The Site</h1><p>A motto of the site that is quite long for a header of a page</p></header><main>%s</main><aside><p>" + "Sidebar words go on and on. " * 9 + "</p></aside></body>",
    "divs": "<body><div class='top-menu'>" + MENU + "</div><div id='page'><div class='content'>%s</div><div class='sidebar-right'><p>" + "Side talk without an end. " * 12 + "</p></div></div><div class='footer'>Copyright us</div>",
    "plain": "<body><div>" + MENU + "</div><div class='x1'>%s</div><div>Copyright us</div></body>",
    "notices": "<body><div class='cookie-notice'><p>" + "We use cookies to make this better. " * 6 + "</p></div><div class='post-body'>%s</div><form action=/s><label>Your name</label><input name=q><p>Send us your address, please do.</p></form></body>",
    "comments": "<body><article>%s</article><section id='comments'><h3>3 comments</h3><div class='comment'><p>" + "I disagree with all that is said here. " * 9 + "</p></div></section></body>",
    "comments inside": "<body><article>%s<div class='reader-comments'><article class='comment'><p>" + "What a read, I must say, at length. " * 20 + "</p></article></div></article></body>",
    "comments by heading": "<body><main>%s<section><h2>Comments (2)</h2><p>" + "First. " * 50 + "</p></section></main></body>",
    "adverts": "<body><div class=\"ad\">Buy now</div><div role=main>%s<div class='ad-slot'>" + "Buy more of it today. " * 20 + "</div></div><script>var a='<p>no</p>';</script><!-- <p>not me</p> --></body>",
    "form around": "<body><form id=aspnet><div class=header>Site</div><main>%s</main></form></body>",
    "unclosed": "<body><nav>" + MENU + "</nav><article>%s</article><footer><p>Copyright us",
    "named clutter": "<body><div class='page-wrap sidebar'><div class=nav>Home</div>%s</div></body>",
    "wrapped form": "<body><div class='content-with-sidebar'>%s</div><div class='newsletter-signup'>Get our letter by mail every day</div></body>",
}


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("style", range(4))
def test_main_text_of_pages(frame, style):
    rng = random.Random(style * 31 + len(frame))
    blocks = [words(rng, n) for n in (5, 60, 40, 2, 90, 30, 1)]
    if style == 0:
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    elif style == 1:  # nothing is closed
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p><b>{b}<br>" for b in blocks[1:])
    elif style == 2:  # marks, references and white space inside blocks
        body = f"<h1>{blocks[0]}</h1>" + "".join("<p>" + b.replace(" ", "\n&nbsp;<i> ", 1).replace("alpha", "al<b>p</b>h&#97;") + "</i></p>\n" for b in blocks[1:])
    else:  # lists, quotes and tables belong to it
        body = f"<h1>{blocks[0]}</h1><p>{blocks[1]}</p><blockquote>{blocks[2]}</blockquote><ul><li>{blocks[3]}</li><li>{blocks[4]}</li></ul><table><tr><td>{blocks[5]}<td>{blocks[6]}</table><p>{blocks[1]}</p>"
        blocks.append(blocks[1])
    assert main_text(FRAMES[frame] % body) == " ".join(blocks)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "just text"), (4, "u", "<div class=ad>x</div>"), (5, "u", "<p>a &lt;b&gt; &amp; ü&#x1F600;</p><script>if (a<b) x()"), (6, "u", "<![foo <p>x"), (7, "u", "<p>" + "long " * 200_000), (7, "u", "<article><p>.</article>")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in extract(table).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "just text", 9), (4, "u", "", 0), (5, "u", "a <b> & ü\U0001f600", 10), (6, "u", "x", 1), (7, "u", ("long " * 200_000).strip(), 999_999), (7, "u", ".", 1)], key=str)
    assert extract(table.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["<!--" * 20_000, "<a " * 20_000, "&" * 100_000, "<" * 50_000, "<div>" * 30_000 + "x", "<![ foo" * 9_000, "</p>" * 30_000, "<li>x" * 20_000, "<h2>Comments</h2><p>x</p>" * 3_000, "<form>" * 3_000 + "<article>x</article>" * 3_000, "<table><tr><td>x" * 9_000])
def test_pages_that_never_end_are_read_in_linear_time(text):
    import time

    began = time.perf_counter()
    main_text(text)
    assert time.perf_counter() - began < 5


def test_pages_without_an_article_are_empty():
    assert main_text("<nav>" + MENU + "</nav><div class='ad'><p>Buy " + "this " * 60 + "</p></div><footer>Us</footer>") == ""
    assert main_text("<nav><a href=/>Home</a></nav><article></article><footer>Us</footer>") == ""


def test_smoothing_and_threshold():
    assert smoothed([1.0]) == [1.0] and smoothed([0.0, 0.0, 9.0, 0.0, 0.0])[2] == max(smoothed([0.0, 0.0, 9.0, 0.0, 0.0]))
    assert threshold([2.0, 2.5]) == 2.0 and 1.0 < threshold([1.0, 1.0, 5.0, 5.2]) < 5.0


def search_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    bags = [(d, Counter(search_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, length = len(bags), sum(b.total() for _, b in bags)
    out = []
    for item, text in items:
        asked, found = sorted(set(search_terms(text))), []
        weigh = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in b for _, b in bags) + 1))) for t in asked}
        for d, b in bags:
            m = 50 + (50 * b.total() * total) // length
            score = sum(weigh[t] * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in asked if t in b)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, at_once, piece", [(1 << 15, 256, 1 << 20), (7, 3, 11)])
def test_search_matches_brute_force(spark, monkeypatch, block, at_once, piece):
    monkeypatch.setattr(treap, "BLOCK_DOCS", block)
    monkeypatch.setattr(treap, "AT_ONCE", at_once)
    monkeypatch.setattr(treap, "PIECE", piece)
    rng = random.Random(11)
    vocabulary = [a + b for a in "ka lo Ñi nu 1a te".split() for b in "n R s".split()]
    docs = [(i, " ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=rng.randint(1, 30)))) for i in range(120)]
    docs += [(7, docs[7][1]), (500, docs[7][1]), (None, docs[8][1]), (501, None), (502, ""), (503, " -- \n"), (504, "kan_KAN`kan kan日本"), (505, "lor " * 40_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=5))) for i in range(9)] + [(3, "kan lor"), (None, "tes tes"), (20, None), (21, ""), (22, "absent"), (23, "日本 1ar")]
    table = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, n long, score long, item int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, doc_id long")
    want = brute_search(docs, items, 6)
    assert sorted(map(tuple, treap.ranked_search(table, asked, k=6).collect()), key=str) == want
    monkeypatch.setattr(treap, "SLICE_BYTES", 64)
    assert sorted(map(tuple, treap.ranked_search(table, asked, k=6).collect()), key=str) == want
    assert treap.ranked_search(table.limit(0), asked).collect() == [] and treap.ranked_search(table, asked.limit(0)).collect() == []


def test_a_treap_finds_what_a_scan_finds():
    rng = np.random.default_rng(4)
    for n_rows, n_columns in ((1, 1), (1, 9), (40, 3), (13, 500)):
        cells = np.unique(rng.integers(0, n_rows * n_columns, 400))
        impacts = rng.integers(1, 20, len(cells))
        grid = treap.Treap(cells // n_columns, cells % n_columns, impacts, n_rows, n_columns)
        keys = np.stack([np.zeros(n_columns, np.int64), rng.permutation(n_columns)], 1)
        dense = np.zeros((n_rows, n_columns), np.int64)
        dense[cells // n_columns, cells % n_columns] = impacts
        rows = rng.choice(n_rows, max(1, n_rows // 3), replace=False)
        sums = dense[rows].sum(0)
        order = [c for c in np.lexsort((keys[:, 1], -sums)) if sums[c] > 0][:8]
        scores, found = grid.search(rows, 8, keys, (np.zeros(0, np.int64), np.zeros((0, 2), np.int64)))
        assert scores.tolist() == sums[order].tolist() and found.tolist() == keys[order].tolist()


@pytest.mark.skipif(not TABLES.is_dir(), reason="the test tables are not here")
def test_every_language_score_again(spark):
    """All rows of the smallest table scored text by text from the fitted tables, without numpy's reductions."""
    docs = spark.read.parquet(str(TABLES / "documents.parquet"))
    rows = docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id")) != 0)
    model = langid.fit_languages(rows, Scratch(spark, "again"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in langid.identify(docs).collect():
        text = texts[r["doc_id"]]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        margins = [0.0] * model.code.shape[1]
        for _, _, buckets, _ in langid.grams(pa.array([text])):
            for b, n in Counter(buckets.tolist()).items():
                margins = [m + n * float(t) for m, t in zip(margins, model.table[b])]
        margins = [max(-30.0, min(30.0, langid.EVIDENCE * m)) for m in margins]
        losses = [sum(w * math.log1p(math.exp(-m * (1 if bit else -1))) for m, w, bit in zip(margins, model.weight, code)) for code in model.code]
        best = min(range(len(losses)), key=lambda i: losses[i])
        score = 1 / sum(math.exp(losses[best] - x) for x in losses)
        assert r["lang_pred"] == model.langs[best] and abs(r["score"] - score) < 1e-4


@pytest.mark.skipif(not TABLES.is_dir(), reason="the test tables are not here")
def test_every_quality_score_again(spark, monkeypatch):
    """All rows of the smallest table scored pair by pair from the fitted weights, without the identity of squares."""
    fitted = []
    monkeypatch.setattr(quality, "pickle", SimpleNamespace(loads=lambda x: fitted.append(pickle.loads(x)) or fitted[-1], dumps=pickle.dumps))
    docs, labels = (spark.read.parquet(str(TABLES / f"{t}.parquet")) for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels, metadata=("n_chars",)).collect()}
    model = fitted[0]
    for r in docs.select("doc_id", "text", "n_chars").collect():
        size = np.array([[math.copysign(math.log1p(abs(r["n_chars"] or 0)), r["n_chars"] or 0)]])
        (_, _, *row), *_ = quality.features(pa.array([r["text"]], pa.string()), size)
        index, value, _ = model.rows(*row)
        raw, before = model.bias, np.zeros(model.factor.shape[1])
        for i, v in zip(index.tolist(), value.tolist()):
            own = model.factor[i] * v
            raw += model.linear[i] * v + float(own @ before)  # its pairs with all before it
            before = before + own
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-6 and got[r["doc_id"]]["predicted"] == int(want >= 0.3)


def test_neighbours_in_clusters_of_very_different_sizes(spark):
    rng = np.random.default_rng(8)
    sizes = (rng.pareto(1.2, 60) * 40 + 20).astype(int)
    data = np.concatenate([rng.normal(size=64) * 3 + rng.normal(size=(n, 64)) * rng.uniform(0.05, 1) for n in sizes])[:12_000].astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(6)
    got: dict[int, set] = {}
    for r in nearest_neighbours(table, every=100, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits, wide = 0, data.astype(float)
    for q in range(0, len(data), 100):
        far = ((wide - wide[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(len(far)), far))[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9

"""HTML extraction and top-k search against brute force."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest
from conftest import SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stevedore.llm import html_text, topk
from stevedore.llm.cases import CASES


def test_html_query(spark):
    """The table's articles are flat: their paragraphs can be cut out by plain expressions."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    rows = CASES["op2_html"](spark, SF01).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        expected = "\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))
        assert r.text == expected and r.n_chars == len(expected)


def blocks(page):
    return [t for t, _ in html_text.blocks(page)]


def test_markup_that_is_not_the_article():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="home">
      <header>no</header><nav><ul><li>no</ul></nav><div id="cookie-notice">no</div><aside>no</aside>
      <main><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>&nbsp; line<br>two<p>Next <a href="x">link</a>
      <!-- <p>no</p> --><script>var a = "<p>no</p>";</script><div class="share buttons">no</div><form><p>no</form>
      <table><tr><td>a<td>b</table><ul><li>x<li>y</ul><pre> p  q </pre><section class="comments"><p>no</p></section>
      <div style="display: none">no</div><div hidden>no</div><img alt="no"></main><footer>no"""
    assert blocks(page) == ["Title & more", "One bold line two", "Next link", "a", "b", "x", "y", "p q"]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", []),
        ("plain text", ["plain text"]),
        ("<p>a<p>b", ["a", "b"]),
        ("</div></p>a", ["a"]),
        ("a < b and <c", ["a"]),
        ("<div><p>a</div>b", ["a", "b"]),
        ("<script>never closed <p>x", []),
        ("<!-- never closed <p>x", []),
        ("<p title='a > b'>x</p>", ["x"]),
        ("&#x41;&#66;&eacute;&unknown;", ["ABé&unknown;"]),
    ],
)
def test_broken_markup(page, expected):
    assert blocks(page) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pdiv!-&;a \"'=", max_size=80))
def test_any_page_parses(page):
    assert all(t == " ".join(t.split()) and t for t in blocks(page))


def test_templates_are_subtrees_on_many_pages_of_a_host(spark):
    page = lambda i, extra: f"<body><div><p>Read our terms.</p></div><div><p>Own text {i}.</p></div>{extra}</body>"
    rows = [(i, f"https://a.example/{i}", page(i, "<ul><li>Latest news</ul>" if i % 2 else "")) for i in range(12)]
    rows += [(100, "https://b.example/1", page(100, "")), (101, None, None), (102, "no url", "<p>x"), (103, "https://a.example/c", page(3, ""))]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    for i in range(12):
        assert got[i] == f"Own text {i}."
    # One page of its host is no template; a page that occurs twice isn't either.
    assert got[100] == "Read our terms.\nOwn text 100." and got[101] == "" and got[102] == "x" and got[103] == "Own text 3."
    assert html_text.main_text(df.limit(0)).count() == 0


def brute_top(rows, k, asks):
    """rows: (id, integers). As the operator states it, by comparing everything."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = []
    for i, v in rows:
        if not asks(i):
            continue
        scores = []
        for j, w in rows:
            if j != i:
                scores.append((-sum(a * b for a, b in zip(v, w, strict=False)), j))
        out.append((i, sorted(scores)[:k]))
    return out


def test_topk_query(spark):
    rows = spark.read.parquet(f"{SF01}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64)
    expected = set()
    for i in np.flatnonzero(ids % 100 == 0):
        scores = x @ x[i]
        best = [j for j in np.lexsort((ids, -scores)) if j != i][:10]
        expected |= {(int(ids[i]), n + 1, int(ids[j]), int(scores[j])) for n, j in enumerate(best)}
    got = [tuple(r) for r in CASES["op8_topk"](spark, SF01).collect()]
    assert set(got) == expected and len(got) == len(expected)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_exact(seed):
    """Clusters, ties and copies; enough rows for many steps."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-300, 300, (8, 16))
    x = centres[rng.integers(0, 8, 5000)] + rng.integers(-3, 4, (5000, 16)) * rng.integers(0, 2, (5000, 1))
    ids = rng.permutation(5000)
    pivots = np.vstack([x[:12], np.zeros(16)]).astype(float)
    got = topk.search_block(ids[:40], x[:40], ids, x, pivots, 10)
    for q in range(40):
        scores = x @ x[q]
        best = [j for j in np.lexsort((ids, -scores)) if j != q][:10]
        assert [g[1:] for g in got if g[0] == ids[q]] == [(int(ids[j]), int(scores[j])) for j in best]


def test_topk_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (100, [0.5, 0.5]), (7, [1.0, 0.5]), (8, [1.0, 0.5]), (9, None), (10, [nan, 1.0]), (11, [inf, 1.0])]
    rows += [(12, [None, 1.0]), (None, [1.0, 1.0]), (13, [2.0]), (14, []), (15, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").withColumn("rank", F.lit(1))
    vectors = df.filter(topk.usable(F.col("embedding"))).withColumn("vector", topk.integers(F.col("embedding")))
    got = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    valid = [(0, [1024, 512]), (100, [512, 512]), (7, [1024, 512]), (8, [1024, 512]), (13, [2048]), (14, []), (15, [-1024, -1024])]
    assert got == dict(brute_top(valid, 4, lambda i: i % 100 == 0))
    assert topk.top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_scores_beyond_doubles_are_exact():
    big = 1 << 30
    ids, x = np.arange(3), np.array([[big, 1], [big, 2], [big, 3]], np.int64)
    got = topk.search_block(ids[:1], x[:1], ids, x, np.zeros((1, 2)), 2)
    assert got == [(0, 2, big * big + 3), (0, 1, big * big + 2)]


def test_components_and_scores_beyond_64_bits_are_named(spark):
    from pyspark.errors import PySparkException

    rows = spark.createDataFrame([(100, [1e30, 1.0]), (1, [1.0, 2.0])], "vec_id LONG, embedding ARRAY<DOUBLE>")
    with pytest.raises(PySparkException, match="beyond 64 bits in the vector 100"):
        rows.select(topk.integers(F.col("embedding"), row=F.col("vec_id"))).collect()
    large = spark.createDataFrame([(100, [1 << 40]), (7, [1 << 40]), (8, [3])], "vec_id LONG, vector ARRAY<LONG>")
    with pytest.raises(PySparkException, match="query 100 and vector 7"):
        topk.top_k(large, F.col("vec_id") == 100).collect()
    got = topk.top_k(large.filter("vec_id <> 7"), F.col("vec_id") == 100).collect()
    assert [(r.vec_id, r.score) for r in got] == [(8, 3 << 40)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        # Class words that only say what the page has, or that name the article's own parts.
        ("<div class='site no-sidebar'><article><p>a</article></div>", ["a"]),
        ("<div class='has-header'><p>a</div>", ["a"]),
        ("<main class='with-sidebar'><p>a</main>", ["a"]),
        ("<article><section id='search-algorithms'><p>a</section></article>", ["a"]),
        ("<article><h2 id='related-work'>a</h2><p>b</article>", ["a", "b"]),
        ("<article><div class='entry-header'><h1>a</h1></div><p>b</article>", ["a", "b"]),
        # Captions and formulas belong to the text; a formula's source doesn't.
        ("<article><figure><img><figcaption>a</figcaption></figure><p>b <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> c</article>", ["a", "b x=1 c"]),
        # An article element beside the text, and elements by class that hold it.
        ("<div><article><p>teaser</article></div><div><p>A body outside of any article element.</div>", ["teaser", "A body outside of any article element."]),
        ("<div class='sidebar'><article><p>the text</article></div><p>no</p>", ["the text"]),
        ("<div class='related'><main><p>a</main></div>", ["a"]),
        ("<form><div class='menu'>no</div><p>The whole page is in a form.</form>", ["The whole page is in a form."]),
        # These still go, however long.
        ("<article><p>a</article><div id='comments'><article class='comment'><p>no, no, no, no</article></div>", ["a"]),
        ("<article><p>a<div class='post-comments'><p>no, no, no, no</div></article>", ["a"]),
        ("<div class='site-header'>no</div><article>a</article><div class='ad-slot'>no</div><div class='related-posts'><article>no</article></div>", ["a"]),
        ("<p>a</p><div class='left-sidebar'>n</div><div class='search'>n</div>", ["a"]),
    ],
)
def test_page_layouts(page, expected):
    assert blocks(page) == expected

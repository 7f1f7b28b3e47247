import html
import itertools
import random
import re

import numpy as np
import pytest

from daypanel.llm import html_extract as H
from daypanel.llm.dom import blocks, parse

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return H.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    page = parse("<div><p>a<b>b</b></p><ul><li>c</li></ul></div><nav>d</nav>")
    trees, _ = H.describe([page])
    m = H.Model(rng.normal(size=H.FEATURES), 0.2, rng.normal(size=(3, 2, 2)))
    n = len(page.tag)
    unary = trees.features @ m.weights + m.bias
    total, one, pair = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for x in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(unary[i] * x[i] for i in range(n)) + sum(m.edges[trees.kind[i], x[p], x[i]] for i, p in enumerate(page.parent) if p >= 0))
        total += w
        for i in range(n):
            one[i] += w * x[i]
            if page.parent[i] >= 0:
                pair[i, x[page.parent[i]], x[i]] += w
    got, pairs = H.marginals(trees, m)
    assert np.allclose(got, one / total) and np.allclose(pairs, pair / total)


def test_pages_of_the_table(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages, model=model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    same = 0
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(x for x in (" ".join(y.split()) for y in parts) if x)
        same += want == got[r.page_id].text
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert same / len(rows) > 0.98


def test_unseen_layouts(model):
    rng = random.Random(4242)
    kept = lost = wrong = 0
    for _ in range(200):
        page, flag = H.template_labels(*H.template(rng))
        trees, _ = H.describe([page])
        found = H.marginals(trees, model)[0] >= 0.5
        for e, t in page.texts:
            if t and t.strip():
                kept += len(t) * (found[e] and flag[e])
                lost += len(t) * (not found[e] and flag[e])
                wrong += len(t) * (found[e] and not flag[e])
    assert kept / (kept + lost) > 0.93 and kept / (kept + wrong) > 0.93


def test_blocks_references_and_broken_markup():
    page = parse("<div>a &amp; b&nbsp;c\n\n d<br>e<p>f <b>g<p>h</b> &lt;i&#33;<!-- x <p> -->j<script>if (a<b) x='</p>'</script><td>k<td>l</div></em>m<p")
    everything = [t not in ("script",) for t in page.tag]
    assert blocks(page, everything) == "a & b c d e\n\nf g\n\nh <i!j k l\n\nm"
    assert blocks(parse(""), [True]) == ""


def test_edge_cases(spark, model):
    pages = spark.createDataFrame(
        [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "plain words without any markup"), (3, "w", "<p>" + "x y. " * 60000), (4, "z", "<" * 500)],
        "page_id long, url string, html string",
    )
    got = H.extract(pages, model=model).collect()
    assert len(got) == 6 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, None)] == ["", "", ""]
    assert H.extract(pages.limit(0), model=model).collect() == []
    assert H.extract(pages.where("page_id = 1")).count() == 2


def test_unbalanced_quotes_leave_no_markup():
    for source, want in [
        ('<p>Hello <a href="x>link</a> world</p>', "Hello link world"),
        ("<p>Hello <a href='x>link</a> world", "Hello link world"),
        ('<p class=a"b>one</p><p title="a > b" id=x>two</p>', "one\n\ntwo"),
        ('<p data-x="<b>not text</b>">three</p>', "three"),
        ("<p title = 'it \"is\"'>four</p>", "four"),
        ('<p "stray" quote\'>five</p>', "five"),
        ("<p a=>six</p><p a= b>seven</p>", "six\n\nseven"),
        ("1 < 2 and <p>eight", "1 < 2 and\n\neight"),
    ]:
        page = parse(source)
        assert blocks(page, np.ones(len(page.tag), dtype=bool)) == want, source


def test_hostile_pages_take_linear_time(model):
    import time

    def seconds(source):
        began = time.perf_counter()
        H.main_texts([source], model)
        return time.perf_counter() - began

    for make in (
        lambda n: "<div>" * n + "deep text" + "</div>" * n,
        lambda n: "<div><span>" * n + "</b>" * n,
        lambda n: '<a href="' * n,
        lambda n: "<p x='" * n + "y",
        lambda n: "<p =" * n,
        lambda n: "<span>" * n + "<p>" * n,
    ):
        small, large = seconds(make(5_000)), seconds(make(20_000))
        assert large < 8 * small + 2, make(2)

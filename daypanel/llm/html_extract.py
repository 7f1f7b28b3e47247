"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element is a binary variable: content or not. Its own evidence (tag, naming of its class and id, text,
links, punctuation, place) gives a unary potential; an edge to its parent gives a potential that depends on
what kind of element it is. The DOM is a tree, so one sum-product pass upward and one downward give the
exact marginal of every node, for all pages of a batch at once, level by level. Text is kept where its
element is more likely content than not.

The potentials are learnt as a conditional random field: gradient steps on the likelihood of labelled pages.
Labelled pages are a sample of at most ``TRAIN_PAGES`` pages of the table that mark up a single article
(its elements but menus, asides, forms and the like are content), as they are and with their markup
made anonymous, and layouts built from templates that show what the table may lack: sidebars, notices,
adverts, forms, reader comments, articles without markup.

Defined results: a null or empty page has no text; a page without any article has an empty text if no node
is likely content; broken markup is repaired; repeated rows and null ids are rows like any other; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from daypanel.llm import arrays as A
from daypanel.llm.dom import Page, blocks, parse

#: Bound of the pages of the table that are learnt from, and of their size.
TRAIN_PAGES = 120
TRAIN_CHARS = 60_000
TEMPLATES = 480
STEPS = 160
RATE = 0.1
DECAY = 2e-3

#: Groups of tags, and of words in class, id and role that tell an element's part in the page.
TAGS = (
    ("html", "#root"), ("body",), ("head", "title", "meta", "link", "base"), ("article", "main"), ("section", "div", "center"), ("p",),
    ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("a",), ("nav", "search"), ("header", "hgroup"), ("footer",),
    ("aside", "dialog"), ("form", "input", "button", "select", "label", "fieldset", "option", "textarea", "legend"),
    ("script", "style", "noscript", "template", "iframe"), ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"),
    ("blockquote", "pre", "figure", "figcaption"), ("b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "u", "mark", "br", "q", "cite"),
)
HINTS = (
    "nav|menu|breadcrumb|pagination|pager|toc|skip", "side|aside|rail|widget", "foot|copyright|legal", "head|masthead|topbar|logo|brand",
    r"\bads?\b|advert|sponsor|promo|banner", "cookie|notice|consent|alert|gdpr|modal|popup|overlay", "comment|respon|discuss|repl|disqus",
    "form|login|signup|subscribe|newsletter|search", "share|social|related|recommend|tag|author|meta|byline|popular", "article|content|post|entry|story|text|main|body",
)
_HINT = [re.compile(h, re.I) for h in HINTS]
_GROUP = {t: i for i, g in enumerate(TAGS) for t in g}
#: Kinds of edges, by the child: parts of running text, containers, and parts that never hold the article.
_PLAIN = frozenset(t for i in (5, 6, 7, 8, 9, 17, 18, 19) for t in TAGS[i])
_NEVER = frozenset(t for i in (2, 11, 15, 16) for t in TAGS[i])
_NUMBERS = 9
FEATURES = len(TAGS) + 1 + len(HINTS) + _NUMBERS


@dataclass
class Trees:
    """Nodes of several pages: parents before children, parent -1 at a root."""

    parent: np.ndarray
    features: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]


def describe(pages: list[Page]) -> tuple[Trees, np.ndarray]:
    """Trees of the pages, and the first node of each (one entry more)."""
    first = np.concatenate([[0], np.cumsum([len(p.tag) for p in pages])]).astype(np.int64)
    n = int(first[-1])
    parent, kind = np.empty(n, np.int64), np.empty(n, np.int64)
    x = np.zeros((n, FEATURES))
    own, linked, ends, seen = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    depth = np.zeros(n, np.int64)
    hints: dict[str, list[int]] = {}
    for k, page in enumerate(pages):
        base = int(first[k])
        parent[base : first[k + 1]] = [p + base if p >= 0 else -1 for p in page.parent]
        total = 0
        for e, text in page.texts:
            if text and page.tag[e] not in _NEVER:
                size = len(text.strip())
                own[base + e] += size
                total += size
                if size:
                    ends[base + e] += text.count(". ") + text.count(", ") + text.rstrip().endswith((".", "!", "?"))
        done = 0
        in_link = [False] * len(page.tag)
        for e, tag in enumerate(page.tag):
            up = page.parent[e]
            if up >= 0:
                depth[base + e] = depth[base + up] + 1
            in_link[e] = tag == "a" or (up >= 0 and in_link[up])
            if in_link[e]:
                linked[base + e] = own[base + e]
            kind[base + e] = 0 if tag in _PLAIN else 2 if tag in _NEVER else 1
            x[base + e, _GROUP.get(tag, len(TAGS))] = 1
            marks = page.marks[e]
            if marks:
                if marks not in hints:
                    hints[marks] = [i for i, h in enumerate(_HINT) if h.search(marks)]
                x[base + e, [len(TAGS) + 1 + i for i in hints[marks]]] = 1
            seen[base + e] = done / max(1, total)
            done += own[base + e]
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if n else []
    all_, all_linked, all_ends, paragraphs, children = own.copy(), linked.copy(), ends.copy(), np.zeros(n), np.zeros(n)
    for at in levels[:0:-1]:
        for sums in (all_, all_linked, all_ends):
            np.add.at(sums, parent[at], sums[at])
        np.add.at(children, parent[at], 1)
        np.add.at(paragraphs, parent[at], x[at, 5])
    page_of = np.repeat(np.arange(len(pages)), np.diff(first))
    whole = np.maximum(1, all_[first[:-1]][page_of]) if n else all_
    x[:, -_NUMBERS:] = np.stack(
        [
            np.log1p(all_) / 8, np.log1p(own) / 8, all_linked / np.maximum(1, all_), np.minimum(1, all_ends / np.maximum(1, all_ / 50)),
            all_ / whole, np.log1p(paragraphs), seen, (all_ < 25).astype(float), np.minimum(1, own / np.maximum(1, all_)),
        ],
        axis=1,
    )
    return Trees(parent, x, kind, levels), first


@dataclass
class Model:
    """Unary weights (of content against not), and a potential [kind, parent, child] for each edge."""

    weights: np.ndarray
    bias: float
    edges: np.ndarray


def marginals(trees: Trees, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(content marginal of each node, joint marginal [parent, child] of each edge) by sum-product."""
    n = len(trees.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = trees.features @ model.weights + model.bias
    psi = model.edges[trees.kind]
    up = np.zeros((n, 2))
    for at in trees.levels[:0:-1]:
        joint = psi[at] + belief[at][:, None, :]
        up[at] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        np.add.at(belief, trees.parent[at], up[at])
    down = np.zeros((n, 2))
    pairs = np.zeros((n, 2, 2))
    for at in trees.levels[1:]:
        p = trees.parent[at]
        outside = belief[p] + down[p] - up[at]
        joint = psi[at] + outside[:, :, None]
        down[at] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint = joint + belief[at][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
    both = belief + down
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), pairs


def fit(trees: Trees, label: np.ndarray) -> Model:
    """Conditional likelihood by gradient steps with per-parameter sizes."""
    model = Model(np.zeros(FEATURES), 0.0, np.zeros((3, 2, 2)))
    inner = trees.parent >= 0
    observed = np.zeros((3, 2, 2))
    np.add.at(observed, (trees.kind[inner], label[trees.parent[inner]], label[inner]), 1)
    n = max(1, len(label))
    seen = [np.full(FEATURES, 1e-8), 1e-8, np.full((3, 2, 2), 1e-8)]
    for step in range(STEPS):
        p, pairs = marginals(trees, model)
        expected = np.stack([pairs[inner & (trees.kind == k)].sum(axis=0) for k in range(3)])
        grads = [trees.features.T @ (label - p) / n - DECAY * model.weights / 10, float((label - p).sum()) / n, (observed - expected) / n - DECAY * model.edges / 10]
        rate = RATE * (1 - step / STEPS)
        seen = [0.9 * s + 0.1 * g**2 for s, g in zip(seen, grads)]
        model.weights += rate * grads[0] / np.sqrt(seen[0] + 1e-8)
        model.bias += rate * grads[1] / np.sqrt(seen[1] + 1e-8)
        model.edges += rate * grads[2] / np.sqrt(seen[2] + 1e-8)
    return model


#: Elements that are no content within a marked article either.
_APART = frozenset("nav aside footer form script style noscript template iframe button input select".split())


def article_labels(page: Page) -> np.ndarray | None:
    """Content flags of a page that marks up one article; None if it has none or several."""
    roots = [i for i, t in enumerate(page.tag) if t == "article"]
    if len(roots) != 1:
        return None
    flag = np.zeros(len(page.tag), dtype=np.int64)
    for i, up in enumerate(page.parent):
        flag[i] = i == roots[0] or (up >= 0 and flag[up] and page.tag[i] not in _APART)
    return flag


def anonymous(page: Page) -> Page:
    """The page with its semantic containers renamed to plain ones and its naming removed."""
    plain = {"article": "div", "main": "div", "section": "div", "nav": "div", "aside": "div", "header": "div", "footer": "div"}
    return Page([plain.get(t, t) for t in page.tag], page.parent, [""] * len(page.tag), page.texts)


def _words(rng: random.Random, n: int) -> str:
    parts = ["".join(rng.choice("abdegiklmnorstuv") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    for i in range(rng.randint(6, 12), n, 9):
        parts[i - 1] += rng.choice([".", ".", ","])
    return " ".join(parts).capitalize() + rng.choice([".", ".", "", "!"])


def template(rng: random.Random) -> tuple[str, str]:
    """(html, marker): a made-up page; content elements have the attribute ``role="marker"`` for labels.

    The parts around the article are named by tag, by class or id, or not at all.
    """
    mark = "truth"
    links = lambda k: "".join(f"<li><a href='/x'>{_words(rng, rng.randint(1, 3))}</a></li>" for _ in range(k))
    named = lambda tag, names: rng.choice([(tag, ""), ("div", rng.choice(names)), ("div", rng.choice(names)), ("section", rng.choice(names))])

    def part(tag, names, body):
        t, name = named(tag, names)
        attr = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        return f"<{t}{attr}>{body}</{t}>"

    p = lambda n: "".join(f"<p>{_words(rng, rng.randint(3, 60))}</p>" for _ in range(n))
    extras = {
        "nav": lambda: part("nav", ["nav", "menu", "main-menu", "breadcrumbs", "pagination"], f"<ul>{links(rng.randint(2, 9))}</ul>"),
        "header": lambda: part("header", ["header", "site-header", "masthead", "topbar"], f"<h2>{_words(rng, 3)}</h2><p>{_words(rng, 6)}</p>"),
        "aside": lambda: part("aside", ["sidebar", "side", "widget", "rail"], f"<h3>{_words(rng, 2)}</h3>" + rng.choice([p(1), f"<ul>{links(4)}</ul>"])),
        "ad": lambda: part("div", ["ad", "ads", "advert", "banner", "sponsored", "promo"], rng.choice([_words(rng, rng.randint(3, 20)), p(1)])),
        "notice": lambda: part("div", ["cookie-notice", "notice", "consent", "alert", "gdpr-banner"], p(1) + "<button>OK</button>"),
        "comments": lambda: part("section", ["comments", "comment-list", "responses", "discussion"], f"<h3>{_words(rng, 2)}</h3>" + "".join(
            f'<div class="{rng.choice(["comment", "reply", "comment-body"])}"><b>{_words(rng, 1)}</b>{p(1)}</div>' for _ in range(rng.randint(1, 5)))),
        "form": lambda: f"<form><label>{_words(rng, 3)}</label><input><p>{_words(rng, 8)}</p><button>{_words(rng, 1)}</button></form>",
        "share": lambda: part("div", ["share", "social", "related", "tags"], f"<ul>{links(3)}</ul>"),
        "footer": lambda: part("footer", ["footer", "site-footer", "copyright", "legal"], f"&copy; {_words(rng, rng.randint(3, 15))}" + rng.choice(["", p(1)])),
    }
    inline = lambda: rng.choice(["", f" <b>{_words(rng, 2)}</b> ", f" <a href='/y'>{_words(rng, 1)}</a> ", f" <em>{_words(rng, 1)}</em> ", "<br>"])
    body = []
    if rng.random() < 0.8:
        body.append(f"<h1>{_words(rng, rng.randint(2, 9))}</h1>")
    for _ in range(rng.choice([1, 1, 2, 4, 8, 14])):
        kind = rng.random()
        if kind < 0.75:
            body.append(f"<p>{_words(rng, rng.randint(1, 70))}{inline()}{_words(rng, rng.randint(1, 20))}</p>")
        elif kind < 0.82:
            body.append(f"<h2>{_words(rng, 3)}</h2>")
        elif kind < 0.88:
            body.append("<ul>" + "".join(f"<li>{_words(rng, rng.randint(2, 14))}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.92:
            body.append(f"<blockquote><p>{_words(rng, 15)}</p></blockquote>")
        elif kind < 0.95:
            body.append(f"<table><tr><td>{_words(rng, 2)}</td><td>{_words(rng, 2)}</td></tr></table>")
        else:
            body.append(f"<!--{mark}-->" + rng.choice([extras["ad"], extras["share"], extras["aside"], extras["form"]])() + f"<!--/{mark}-->")
    t, attr = rng.choice([("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("div", ' class="post"'), ("div", ""), ("div", "")])
    article = f'<{t}{attr} role="{mark}">' + "".join(body) + f"</{t}>"
    if rng.random() < 0.3:
        article = f"<main>{article}</main>" if t != "main" else f"<div class='wrap'>{article}</div>"
    pick = lambda names, chance: "".join(extras[k]() for k in names if rng.random() < chance)
    before, after = pick(["notice", "header", "nav", "ad", "form"], 0.6), pick(["share", "comments", "aside", "ad", "form", "notice", "footer"], 0.6)
    head = f"<head><title>{_words(rng, 4)}</title><style>p{{}}</style><script>var x='<p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{before}{article}{after}</body></html>", mark


def template_labels(source: str, mark: str) -> tuple[Page, np.ndarray]:
    """The parsed template without its marks, and the content flags they stood for."""
    page = parse(source)
    flag = np.zeros(len(page.tag), dtype=np.int64)
    apart = parse(re.sub(rf"<!--{mark}-->(<\w+)", r'\1 role="apart" ', source))
    for i, up in enumerate(page.parent):
        root = mark in page.marks[i].split()
        flag[i] = root or (up >= 0 and flag[up] and "apart" not in apart.marks[i].split())
    page.marks = [" ".join(w for w in m.split() if w != mark) for m in page.marks]
    return page, flag


def train(pages: DataFrame, html_column: str = "html", seed: int = 12) -> Model:
    """Fit on a bounded sample of the table and on the templates."""
    source = F.col(html_column)
    marked = pages.select(source.alias("html"), F.xxhash64(source).alias("key")).where(
        source.contains("<article") & (F.length(source) < TRAIN_CHARS)
    )
    # The keys are picked in the cluster; only the pages they stand for are sent to the driver, each once.
    keys = marked.select("key").distinct().orderBy("key").limit(TRAIN_PAGES)
    sample = marked.join(F.broadcast(keys), "key").groupBy("key").agg(F.min("html").alias("html"))
    rng = random.Random(seed)
    found: list[tuple[Page, np.ndarray]] = []
    for row in sorted(sample.collect(), key=lambda r: r.key):
        page = parse(row.html)
        flag = article_labels(page)
        if flag is not None:
            found.append((page, flag))
            if len(found) % 3 == 0:
                found.append((anonymous(page), flag))
    found += [template_labels(*template(rng)) for _ in range(TEMPLATES)]
    trees, _ = describe([p for p, _ in found])
    return fit(trees, np.concatenate([f for _, f in found]))


def main_texts(sources: list[str], model: Model) -> list[str]:
    """Main text of each page."""
    pages = [parse(s) for s in sources]
    trees, first = describe(pages)
    content = marginals(trees, model)[0] >= 0.5
    return [blocks(p, content[first[i] : first[i + 1]]) for i, p in enumerate(pages)]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html", model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``."""
    model = train(pages, html_column) if model is None else model
    schema = StructType(
        [StructField("page_id", pages.schema[page_id].dataType), StructField("url", pages.schema[url].dataType),
         StructField("text", StringType()), StructField("n_chars", LongType())]
    )

    def run(batch):
        texts = main_texts([h or "" for h in batch.column(2).to_pylist()], model)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names
        )

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_column).alias("html"))
    return A.map_texts(rows, "html", run, schema)

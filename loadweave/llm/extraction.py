"""Main text of web pages: boosted trees over DOM nodes and a decoding that respects the tree.

Every block node of a page is described by its own and its subtree's text,
link and tag densities, its tag, attribute tokens, depth and siblings, and the
same of what lies above it. Gradient-boosted trees (Spark ML) give the chance
that a node belongs to the article. The page is then decoded as a whole: a node
is outside, article or other matter; other matter has nothing but other matter
below it, and the article only article or other matter, so an ancestor and a
descendant cannot contradict each other. The best assignment is found exactly,
from the leaves up.

The trees are fitted once per process on `pages` made pages whose blocks are
labelled by construction; no table carries such labels. Every page is scored
whole, in one task, so an executor that is lost costs its pages only.

Null or empty pages, and pages without an article, give the empty text. Text
that is not shown (scripts, styles, comments, hidden elements) is never used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T

from loadweave.llm.dom import Page, features

TURN = 2.0  # cost of an article region's start, and of other matter inside one


class Forest:
    """The fitted trees as flat arrays."""

    def __init__(self, model):
        self.trees, self.weights = [], list(model.treeWeights)
        for tree in model.trees:
            rows: list[list[float]] = []

            def add(node) -> int:
                at = len(rows)
                rows.append([-1, 0.0, 0, 0, node.prediction()])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    rows[at][:2] = [split.featureIndex(), split.threshold()]
                    rows[at][2], rows[at][3] = add(node.leftChild()), add(node.rightChild())
                return at

            add(tree._call_java("rootNode"))
            table = np.array(rows)
            self.trees.append((table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]))

    def chance(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.zeros(len(x)), np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), dtype=int)
            while (inner := feature[at] >= 0).any():
                go_left = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def decoded(parent: list[int], chance: np.ndarray, weight: np.ndarray, turn: float = TURN) -> np.ndarray:
    """True for the nodes of the article, under the best consistent assignment."""
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
    n = len(parent)
    outside, article, other = no[:], yes[:], no[:]
    for k in range(n - 1, 0, -1):  # children come after their parents
        up = parent[k]
        outside[up] += max(outside[k], article[k] - turn, other[k])
        article[up] += max(article[k], other[k] - turn)
        other[up] += other[k]
    state = [0] * n
    state[0] = 1 if article[0] - turn > outside[0] else 0
    for k in range(1, n):
        above = state[parent[k]]
        if above == 0:
            state[k] = 1 if article[k] - turn > max(outside[k], other[k]) else (0 if outside[k] >= other[k] else 2)
        elif above == 1:
            state[k] = 1 if article[k] >= other[k] - turn else 2
        else:
            state[k] = 2
    return np.array(state) == 1


def main_texts(pages: list[str | None], forest: Forest) -> list[str]:
    """Main text of each page; the nodes of all pages are scored together."""
    trees = [Page(html) for html in pages]
    described = [features(page) for page in trees]
    chances = forest.chance(np.concatenate(described)) if described else np.zeros(0)
    out, at = [], 0
    for page, x in zip(trees, described):
        keep = decoded(page.parent, chances[at : at + len(x)], 1.0 + np.minimum(1.0, x[:, 0] / 6))
        out.append(" ".join(text for node, text in page.blocks if keep[node] and text))
        at += len(x)
    return out


def made_page(rng: np.random.Generator) -> str:
    """A labelled page in one of many layouts: `data-label` is 1 on the article, 0 on what is not part of it."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    syllables = "an er ti on re ou la de be sch ung el mo ta ri ne so vi pa ko".split()
    word = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(1, 5))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    sentence = lambda: words(3, 18).capitalize() + pick(".", ".", ",", "!", "?")
    prose = lambda a, b: " ".join(sentence() for _ in range(int(rng.integers(a, b))))
    chance = lambda p: rng.random() < p
    named = lambda *names: pick("", f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{word()} {pick(*names)}-{word()}"')

    def links(a: int, b: int) -> str:
        each = [f'<a href="/{word()}">{words(1, 4)}</a>' for _ in range(int(rng.integers(a, b)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if chance(0.6) else pick(" ", " | ", "").join(each)

    def menu() -> str:
        tag = pick("nav", "nav", "div", "ul")
        return f'<{tag}{named("menu", "nav", "navbar", "breadcrumbs", "links")} data-label="0">{links(3, 12)}</{tag}>'

    def header() -> str:
        tag = pick("header", "div")
        return f'<{tag}{named("header", "masthead", "topbar", "banner")} data-label="0"><div>{words(1, 5)}</div>{menu() if chance(0.6) else ""}<p>{words(2, 8)}</p></{tag}>'

    def footer() -> str:
        tag = pick("footer", "footer", "div")
        return f'<{tag}{named("footer", "site-footer", "copyright", "legal")} data-label="0">{pick("&copy; ", "")}{words(2, 9)} {prose(0, 3)}{links(0, 6) if chance(0.4) else ""}</{tag}>'

    def advert() -> str:
        tag = pick("div", "div", "aside", "p", "section")
        names = pick(' class="ad"', ' class="ads"', ' class="advert"', ' id="ad-1"', ' class="sponsored promo"', ' class="banner-ad"', ' class="advertisement"')
        return f'<{tag}{names} data-label="0">{prose(1, 4)}{links(1, 2) if chance(0.3) else ""}</{tag}>'

    def sidebar() -> str:
        tag = pick("aside", "div", "section")
        inner = "".join(pick(f"<h3>{words(1, 4)}</h3>{links(2, 8)}", f"<p>{prose(1, 3)}</p>", f"<div>{words(3, 9)}</div>") for _ in range(int(rng.integers(1, 4))))
        return f'<{tag}{named("sidebar", "side", "widget", "related", "rail", "share")} data-label="0">{inner}</{tag}>'

    def notice() -> str:
        tag = pick("div", "section", "p", "aside")
        name = pick("cookie-notice", "cookies", "consent", "notice", "alert", "newsletter", "popup", "gdpr", "modal", "subscribe")
        return f'<{tag} {pick("class", "id")}="{name}" data-label="0">{prose(1, 4)}{pick("", "<button>" + words(1, 3) + "</button>")}</{tag}>'

    def form() -> str:
        return f'<form{named("search", "signup", "login", "form")} data-label="0"><label>{words(1, 4)}</label><input name="q"><p>{words(2, 8)}</p><button>{words(1, 2)}</button></form>'

    def comments() -> str:
        tag, name = pick("div", "section", "ul", "aside"), pick("comments", "comment-list", "replies", "discussion", "reader-comments", "respond")
        inner = "".join(f'<div class="{pick("comment", "reply", "comment-item")}"><b>{words(1, 3)}</b><p>{prose(1, 5)}</p></div>' if chance(0.8) else f'<article class="comment"><p>{prose(1, 4)}</p></article>' for _ in range(int(rng.integers(1, 6))))
        return f'<{tag} {pick("class", "id")}="{name}" data-label="0">{f"<h3>{words(1, 3)}</h3>" if chance(0.5) else ""}{inner}</{tag}>'

    def block() -> str:
        body = prose(1, pick(3, 8, 14))
        if chance(0.15):
            body = pick("<b>", "<em>", '<a href="/x">') + body.replace(" ", pick("</b> ", "</em> ", "</a> "), 1)
        return pick(*[f"<p>{body}</p>"] * 8, f"<p>{body}", f"<h2>{words(2, 8)}</h2>", f"<ul>{''.join(f'<li>{words(3, 12)}</li>' for _ in range(3))}</ul>",
                    f"<blockquote><p>{body}</p></blockquote>", f"<div>{body}</div>", f"<p><b>{words(3, 12)}<br>{body}", f"<pre>{words(5, 30)}</pre>",
                    f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>")

    def article() -> str:
        tag = pick("article", "article", "article", "main", "div", "div", "section", "td")
        names = named("article", "content", "post", "entry-content", "story", "main", "article-body", "text") if tag != "div" or chance(0.3) else \
            f' {pick("class", "id")}="{pick("content", "article", "post", "entry-content", "story-body", "main-text", "post-body")}"'
        title = f"<h1>{words(2, 10)}</h1>"
        inside = [title if chance(0.7) else f"<header>{title}</header>" if chance(0.5) else ""]
        for _ in range(int(rng.integers(1, pick(3, 8, 20)))):
            inside.append(block())
            if chance(0.15):
                inside.append(pick(advert, sidebar, notice, form, menu)())
        if chance(0.12):
            inside.append(pick(comments, sidebar, footer)())
        made = f'<{tag}{names} data-label="1">{"".join(inside)}</{tag}>'
        return f"<table><tr>{made}</tr></table>" if tag == "td" else made

    around = lambda *parts: [f() for f in parts if chance(0.45)]
    before = around(header, menu, advert, notice, sidebar, form)
    after = around(comments, sidebar, advert, form, notice, menu, footer, footer)
    middle = "".join([*around(sidebar), article(), *around(sidebar, comments)]) if chance(0.5) else article()
    wrap = pick("{}", "{}", '<div id="page">{}</div>', "<main>{}</main>", '<div class="wrapper"><div class="row">{}</div></div>', '<div class="container">{}</div>')
    return f'<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body data-label="0">{"".join(before)}{wrap.format(middle)}{"".join(after)}</body></html>'


def _examples(pages: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                page = Page(made_page(np.random.default_rng([seed, int(k)])))
                x = features(page)
                used = [j for j in range(1, len(page.parent)) if page.label[j] is not None and not page.silent[j]]
                yield pd.DataFrame({"x": [r.tolist() for r in x[used]], "label": [float(page.label[j]) for j in used]})

    return run


@lru_cache(maxsize=4)
def trained(spark: SparkSession, pages: int = 400, trees: int = 30, depth: int = 5, seed: int = 11) -> Forest:
    """Fit on `pages` made pages; their number bounds the work whatever the table's size."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(0, pages, 1, 4).mapInPandas(_examples(pages, seed), "x array<double>, label double")
    rows = rows.select(array_to_vector("x").alias("features"), "label").cache()
    try:
        return Forest(GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, maxBins=32).fit(rows))
    finally:
        rows.unpersist()


def extracted(pages: DataFrame, forest: Forest | None = None, html: str = "html", column: str = "text") -> DataFrame:
    """All columns of `pages` except the markup, and the main text; a column of that name is replaced."""
    forest = forest or trained(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in (html, column)]
    schema = T.StructType([*kept, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = pdf[[f.name for f in kept]].copy()
            done[column] = main_texts(pdf[html].tolist(), forest)
            yield done

    return pages.drop(column).mapInPandas(run, schema)

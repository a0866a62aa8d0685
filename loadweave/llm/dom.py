"""A page as block nodes: the tree, the text of each block and numbers that describe a node."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

VOID = set("area base br col embed hr img input link meta source track wbr param".split())
#: never shown, or never text of an article
SILENT = set("script style noscript template head title iframe object svg math canvas audio video select datalist".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong "
    "sub sup time tt u var wbr img nobr".split()
)
#: an opening tag of the key closes an open tag of the value, not beyond the limits
_P_ENDS = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_LIMITS = {"ul", "ol", "dl", "table", "select", "menu", "body", "html", "article", "section", "main", "div"}
_GROUPS = ["p", "div", "span", "li", "ul", "h", "article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "pre", "body"]
_SAME_GROUP = {"ol": "ul", "menu": "ul", "dl": "ul", "dt": "li", "dd": "li", "blockquote": "p", "figure": "p", "figcaption": "p", "td": "table",
               "th": "table", "tr": "table", "tbody": "table", "thead": "table", "fieldset": "form", "button": "form", "textarea": "form",
               "dialog": "aside", "html": "body", **{f"h{k}": "h" for k in range(1, 7)}}
_STEMS = {
    "good": "article content post entry story body main text prose page blog news".split(),
    "menu": "nav menu breadcrumb crumb toolbar topbar pagination pager tabs links toc".split(),
    "edge": "header footer foot masthead banner copyright legal imprint sidebar side aside widget rail".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner teaser related recommend share social".split(),
    "notice": "cookie consent notice alert popup modal overlay newsletter subscribe signup login form search gdpr privacy".split(),
    "reply": "comment comments reply replies respond discussion disqus reader feedback review".split(),
}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SHORT = 3  # stems up to this length must be a whole token


def _attribute_marks(attrs: list) -> tuple[int, ...]:
    words = [t.lower() for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label") and v for t in _TOKEN.findall(v)]
    return tuple(int(any(w == s or (len(s) > SHORT and w.startswith(s)) for w in words for s in stems)) for stems in _STEMS.values())


def _hidden(attrs: list) -> bool:
    given = dict(attrs)
    style = (given.get("style") or "").replace(" ", "").lower()
    return "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class Page(HTMLParser):
    """Block nodes in page order; inline tags only add to the counts of their block."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.marks, self.silent = [-1], ["html"], [(0,) * len(_STEMS)], [False]
        self.label: list[int | None] = [None]
        self.runs: list[tuple[int, list[str]]] = []  # (block, text pieces) in page order
        self.links, self.inline = [0], [0]
        self._open: list[tuple[str, int]] = [("html", 0)]
        self._anchors, self._fresh = 0, True
        self.feed(html or "")
        self.close()
        self.blocks = [(node, " ".join("".join(parts).split())) for node, parts in self.runs]

    def _pop_to(self, depth: int) -> None:
        self._anchors = sum(t == "a" for t, _ in self._open[:depth])
        del self._open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and len(self._open) == 1 and tag == "html":
            return
        if tag in INLINE or tag == "br":
            if tag == "br":
                self._fresh = True
            elif tag not in VOID:
                node = self._open[-1][1]
                if _hidden(attrs):
                    node = self._node(tag, attrs)
                    self._fresh = True
                self._open.append((tag, node))
                self._anchors += tag == "a"
            self.inline[self._open[-1][1]] += 1
            return
        self._fresh = True
        if tag in VOID:
            return
        closing = {"p"} if tag in _P_ENDS else set()
        for depth in range(len(self._open) - 1, 0, -1):
            name = self._open[depth][0]
            if name in closing or name in _CLOSES.get(tag, ()):
                self._pop_to(depth)
                break
            if name in _LIMITS:
                break
        self._open.append((tag, self._node(tag, attrs)))

    def _node(self, tag: str, attrs: list) -> int:
        above = self._open[-1][1]
        self.parent.append(above)
        self.tag.append(tag)
        self.marks.append(_attribute_marks(attrs))
        self.silent.append(self.silent[above] or tag in SILENT or _hidden(attrs))
        self.links.append(0)
        self.inline.append(0)
        label = dict(attrs).get("data-label")  # only made pages carry it
        self.label.append(int(label) if label in ("0", "1") else self.label[above])
        return len(self.parent) - 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" or tag not in INLINE:
            self._fresh = True
        for depth in range(len(self._open) - 1, 0, -1):
            name, node = self._open[depth]
            if name == tag:
                if node != self._open[depth - 1][1]:
                    self._fresh = True
                self._pop_to(depth)
                return
            if tag in INLINE and name not in INLINE:
                return  # an inline end tag does not close blocks

    def handle_data(self, data: str) -> None:
        node = self._open[-1][1]
        if self.silent[node]:
            return
        if self._fresh or not self.runs or self.runs[-1][0] != node:
            if not data.strip():
                return
            self.runs.append((node, []))
            self._fresh = False
        self.runs[-1][1].append(data)
        if self._anchors:
            self.links[node] += len(data.strip())


def _summed(parent: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum over each node's subtree; parents come before children."""
    total = own.astype(np.float64).tolist()
    for k in range(len(total) - 1, 0, -1):
        total[parent[k]] += total[k]
    return np.array(total)


def features(page: Page) -> np.ndarray:
    """One row per node: density of its subtree, tags, attribute tokens, depth and siblings."""
    n = len(page.parent)
    parent = page.parent
    length, stops, pieces = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text in page.blocks:
        length[node] += len(text)
        stops[node] += sum(map(text.count, ".,;!?"))
        pieces[node] += 1
    links, tags = np.array(page.links, float), 1.0 + np.array(page.inline)
    in_tree, links_in, tags_in, stops_in, pieces_in = (_summed(parent, x) for x in (length, links, tags, stops, pieces))
    depth, place, same = [0] * n, [0] * n, [0] * n
    children: list[dict[str, int]] = [{} for _ in range(n)]
    count = [0] * n
    near = [(0,) * (len(_STEMS) + len(_GROUPS))] * n
    group = [_GROUPS.index(_SAME_GROUP.get(t, t)) if _SAME_GROUP.get(t, t) in _GROUPS else -1 for t in page.tag]
    own_group = np.zeros((n, len(_GROUPS)))
    for k in range(n):
        if group[k] >= 0:
            own_group[k, group[k]] = 1
        if k:
            p = parent[k]
            depth[k] = depth[p] + 1
            place[k], count[p] = count[p], count[p] + 1
            children[p][page.tag[k]] = children[p].get(page.tag[k], 0) + 1
            # of all nodes above: attribute marks and tag groups
            near[k] = tuple(map(max, near[p], (*page.marks[p], *own_group[p].astype(int).tolist())))
    for k in range(1, n):
        same[k] = children[parent[k]][page.tag[k]]
    siblings = np.array([count[p] if p >= 0 else 1 for p in parent], float)
    total = max(1.0, in_tree[0])
    up = np.array([max(p, 0) for p in parent])
    before = np.zeros(n)
    done, first = 0.0, {}
    for node, text in page.blocks:
        first.setdefault(node, done)
        done += len(text)
    for k in range(n - 1, -1, -1):
        before[k] = first.get(k, total if k == n - 1 else before[k + 1])
    numbers = np.column_stack([
        np.log1p(length), np.log1p(in_tree), in_tree / total, in_tree / tags_in, links_in / np.maximum(in_tree, 1),
        stops_in / np.maximum(in_tree, 1) * 100, in_tree / np.maximum(pieces_in, 1), depth, place, siblings,
        np.array(same) / np.maximum(siblings, 1), before / total,
        np.log1p(in_tree[up]), in_tree[up] / tags_in[up], links_in[up] / np.maximum(in_tree[up], 1), in_tree / np.maximum(in_tree[up], 1),
    ])
    return np.column_stack([numbers, np.array(page.marks), own_group, np.array(near)]).astype(np.float64)

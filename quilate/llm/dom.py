"""A small HTML tree for content extraction: block elements, text blocks, features.

Inline elements make no nodes; their text belongs to the block around them.
Elements without readable text (scripts, styles, form controls and the like) are
skipped with all they hold.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np

#: HTML's element categories.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("button canvas datalist head iframe noembed noframes noscript object script select style svg template textarea title".split())
#: Of these the content is no markup.
RAW = frozenset("iframe noembed noframes noscript script style textarea title".split())
#: What a start tag closes, if it is open within the listed scope.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"})}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Words in attributes that hint at a node's part in the page.
HINTS = {
    "navigation": "nav navbar navigation menu menus breadcrumb breadcrumbs crumb crumbs toc pagination pager paging tabs skip topbar toolbar".split(),
    "header": "header masthead banner logo branding brand hero tagline sitename".split(),
    "footer": "footer foot copyright colophon legal bottom imprint contentinfo".split(),
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending more recent complementary archive tags tagcloud".split(),
    "comment": "comment comments disqus reply replies respond discussion discuss feedback reviews review guestbook thread responses".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion adsense adslot banner dfp affiliate".split(),
    "notice": "cookie cookies consent gdpr notice notices popup modal overlay alert alerts newsletter subscribe subscription signup toast privacy warning dialog alertdialog paywall message".split(),
    "share": "share sharing social follow like buttons button print tweet rating".split(),
    "form": "form search searchform login signin register contact input field".split(),
    "content": "article content contents post entry story main text body page articlebody maincontent prose copy".split(),
    "hidden": "hidden none invisible sr only visually".split(),
}
_HINT = {word: i for i, words in enumerate(HINTS.values()) for word in words}
_N = len(HINTS)
_KINDS = {"p": 0, "h1": 1, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "dd": 3, "dt": 3, "ul": 4, "ol": 4, "dl": 4, "menu": 4, "table": 5, "tr": 5, "td": 5, "th": 5, "tbody": 5, "thead": 5, "tfoot": 5, "caption": 5, "nav": 6, "header": 7, "hgroup": 7, "footer": 8, "aside": 9, "form": 10, "fieldset": 10, "legend": 10, "search": 10, "dialog": 10, "article": 11, "main": 11, "section": 12, "div": 13, "blockquote": 14, "pre": 14, "figure": 14, "figcaption": 14}
_OTHER = 15

#: Names of the columns of ``Page.features``.
FEATURES = [*(f"kind_{i}" for i in range(_OTHER + 1)), *(f"hint_{h}" for h in HINTS), *(f"above_{h}" for h in HINTS), *(f"above_kind_{i}" for i in (6, 7, 8, 9, 10, 11)),
            "is_text", "chars", "words", "link_share", "mean_word", "ends_sentence", "stops", "share_of_page", "blocks", "chars_per_block", "links", "depth", "place", "from_end", "siblings", "sibling_place", "sibling_chars", "previous_chars", "next_chars", "controls", "paragraphs", "before_heading"]


class Page:
    """Nodes of a page in page order; node 0 is the page itself. Text blocks are leaves."""

    def __init__(self, html: str | None):
        self.kind: list[int] = [_OTHER]
        self.tag: list[str] = ["html"]
        self.parent: list[int] = [-1]
        self.hints: list[int] = [0]
        self.text: list[str | None] = [None]
        self.links: list[tuple[int, int]] = [(0, 0)]  # characters in links, links
        self.controls: list[int] = [0]
        self._read(html or "")

    def _node(self, kind: int, tag: str, parent: int, hints: int, text: str | None, links: tuple[int, int]) -> int:
        self.kind.append(kind)
        self.tag.append(tag)
        self.parent.append(parent)
        self.hints.append(hints)
        self.text.append(text)
        self.links.append(links)
        self.controls.append(0)
        return len(self.kind) - 1

    def _read(self, html: str) -> None:
        stack, parts, linked, count, in_link, at = [0], [], 0, 0, False, 0
        tag_of = self.tag

        def flush() -> None:
            nonlocal parts, linked, count
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    owner = stack[-1]
                    self._node(self.kind[owner], "", owner, 0, text, (min(linked, len(text)), count))
            parts, linked, count = [], 0, 0

        def add(raw: str) -> None:
            nonlocal linked
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

        size, endless = len(html), set()
        while at < size:
            m = _TAG.search(html, at)
            if m is None:
                add(html[at:])
                break
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if name in SKIPPED:
                if closing:
                    continue
                if name in ("select", "textarea", "button"):
                    self.controls[stack[-1]] += 1
                if attributes.rstrip().endswith("/") and name not in RAW:
                    continue
                end = None if name in endless else re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(html, at)
                if name == "head" and end is None:
                    end = re.compile(r"(?=<body)", re.IGNORECASE).search(html, at)
                if end is None and name not in RAW:
                    endless.add(name)  # markup without its end tag is read on
                else:
                    at = end.end() if end else size
                parts.append(" ")
            elif name in BLOCKS:
                flush()
                in_link = False
                if closing:
                    for i in range(len(stack) - 1, 0, -1):
                        if tag_of[stack[i]] == name:
                            del stack[i:]
                            break
                    continue
                if name in ("html", "body", "hr"):
                    if name != "hr":
                        self.hints[0] |= self._hints(attributes) & ~(1 << _N - 1)
                    continue
                for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if tag_of[stack[i]] == "p":
                        del stack[i:]
                        break
                    if tag_of[stack[i]] in ("table", "td", "th", "div", "section", "article", "li", "blockquote", "form"):
                        break
                closed, scope = CLOSES.get(name, ((), ()))
                if closed:
                    for i in range(len(stack) - 1, 0, -1):
                        if tag_of[stack[i]] in closed:
                            del stack[i:]
                            break
                        if tag_of[stack[i]] in scope:
                            break
                stack.append(self._node(_KINDS.get(name, _OTHER), name, stack[-1], self._hints(attributes), None, (0, 0)))
            elif name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = not closing
                count += not closing
            elif name in ("input", "label"):
                self.controls[stack[-1]] += not closing
            elif name in ("img", "wbr"):
                pass
        flush()

    @staticmethod
    def _hints(attributes: str) -> int:
        found = 0
        if "=" in attributes or "hidden" in attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name == "hidden":
                    found |= 1 << _N - 1
                elif name == "style":
                    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a + b + c, re.IGNORECASE):
                        found |= 1 << _N - 1
                else:
                    for token in _TOKEN.findall(a + b + c):
                        i = _HINT.get(token.lower())
                        if i is not None:
                            found |= 1 << i
        return found

    def features(self) -> np.ndarray:
        """A row of numbers per node, by ``FEATURES``."""
        n = len(self.kind)
        parent = np.array(self.parent)
        own = np.zeros((n, 8))  # chars, words, linked, links, blocks, stops, controls, paragraphs
        last_stop, word_chars = np.zeros(n), np.zeros(n)
        for i, t in enumerate(self.text):
            if t is not None:
                words = t.count(" ") + 1
                own[i, :6] = len(t), words, self.links[i][0], self.links[i][1], 1, t.count(".") + t.count("!") + t.count("?") + t.count(",")
                last_stop[i] = t[-1] in ".!?…\"'»”:;"
                word_chars[i] = (len(t) - words + 1) / words
            elif self.tag[i] == "p":
                own[i, 7] = 1
        own[:, 6] = self.controls
        total = own.copy()
        depth = np.zeros(n)
        hints = np.array(self.hints)
        kind = np.array(self.kind)
        mask = (hints[:, None] >> np.arange(_N)) & 1
        above, above_kind = np.zeros((n, _N)), np.zeros((n, 6))
        watched = np.stack([kind == k for k in (6, 7, 8, 9, 10, 11)], 1)
        is_text = np.array([t is not None for t in self.text])
        for i in range(n - 1, 0, -1):
            total[parent[i]] += total[i]
        heading = np.cumsum(kind == 1) - (kind == 1)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = np.maximum(above[p], mask[p]) if p else mask[0]
            above_kind[i] = np.maximum(above_kind[p], watched[p])
        chars = total[:, 0]
        whole = max(chars[0], 1)
        order = np.lexsort((np.arange(n), parent))
        siblings, place, mean, before, after = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        begin = 1
        while begin < n:
            end = begin
            while end < n and parent[order[end]] == parent[order[begin]]:
                end += 1
            group = order[begin:end]
            siblings[group] = len(group)
            place[group] = np.arange(len(group)) / len(group)
            mean[group] = chars[group].mean()
            before[group[1:]] = chars[group[:-1]]
            after[group[:-1]] = chars[group[1:]]
            begin = end
        start = np.concatenate([[0], np.cumsum(own[:-1, 0])]) / whole
        out = np.zeros((n, len(FEATURES)))
        out[np.arange(n), kind] = 1
        k = _OTHER + 1
        out[:, k : k + _N] = mask
        out[:, k + _N : k + 2 * _N] = above
        k += 2 * _N
        out[:, k : k + 6] = above_kind
        k += 6
        log = np.log1p
        columns = (is_text, log(chars), log(total[:, 1]), total[:, 2] / np.maximum(chars, 1), word_chars, last_stop, total[:, 5] / np.maximum(total[:, 1], 1), chars / whole, log(total[:, 4]), log(chars / np.maximum(total[:, 4], 1)), log(total[:, 3]), depth, start, 1 - start - chars / whole, log(siblings), place, log(mean), log(before), log(after), log(total[:, 6]), log(total[:, 7]), heading == 0)
        for j, x in enumerate(columns):
            out[:, k + j] = x
        return out

    def decode(self, p: np.ndarray) -> list[str]:
        """The text blocks that stay, given each node's probability of being content.

        The most likely labelling in which nothing below a dropped node is kept:
        from the leaves up, either drop a whole subtree or keep its root and take
        the best choice of each child.
        """
        n = len(self.kind)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        keep, drop = np.log(p), np.log(1 - p)
        keep[0], drop[0] = 0.0, -1e9  # the page itself is no choice
        parent = self.parent
        for i in range(n - 1, 0, -1):
            q = parent[i]
            keep[q] += max(keep[i], drop[i])
            drop[q] += drop[i]
        kept, out = [True] * n, []
        for i in range(1, n):
            kept[i] = kept[parent[i]] and keep[i] > drop[i]
            if kept[i] and self.text[i] is not None:
                out.append(self.text[i])
        return out

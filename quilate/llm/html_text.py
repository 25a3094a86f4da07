"""HTML extraction by gradient-boosted trees over DOM nodes.

Every block element and every block of text gets features: its kind, words in
its attributes and in those above it, subtree densities (text, links, sentences,
controls), depth, place, and statistics of its siblings. Boosted trees give each
node a probability of being part of the article, and the most likely labelling in
which nothing below a dropped node is kept decides (see ``dom``).

No labelled pages exist, so the trees are fitted to pages that ``sample_page``
writes at random: articles of several structures among menus, headers, footers,
sidebars, notices, adverts, forms and comments, with and without telling tags and
attributes. Their number is a parameter; fitting is done once on the driver
and the trees, of fixed size, go to the tasks.

Edge cases: null and empty pages have an empty text; unclosed, misnested and cut
off markup is read as far as it goes; very long pages are read whole; pages
without an article give an empty text; extra columns aren't carried along.
"""

from __future__ import annotations

import random
from functools import lru_cache
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quilate.llm.boosting import BoostedTrees
from quilate.llm.dom import Page

PAGES, SEED = 600, 7
#: Private-use characters mark what belongs to the article in written pages; they are taken off before features are made.
_MARK = ""

_SYLLABLES = "ba be bo da de di do en er es fa fi ga go ha in ing ion ka la le li lo ma me mi na ne no ou pa po ra re ri ro sa se si so st ta te th ti to tion un ur va ve vi".split()


class _Writer:
    """Writes one random page."""

    def __init__(self, rng: random.Random):
        self.r = rng
        self.few_hints = rng.random() < 0.1
        self.words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3, 4)))) for _ in range(120)]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        text = self.some(low, high).capitalize()
        if self.r.random() < 0.3:
            text = text.replace(" ", ", ", 1)
        return text + self.r.choice("....?!")

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def open(self, tag: str, names: str = "", always: bool = False) -> str:
        """A start tag; one of the names becomes its class or id."""
        if not names or (not always and self.r.random() < (0.7 if self.few_hints else 0.12)):
            return f"<{tag}>"
        name = self.r.choice(names.split())
        name = self.r.choice(("", "", "", "site-", "page-", "main-", "c-", "js-", "the", "x_")) + name + self.r.choice(("", "", "", "-box", "-wrap", "-inner", "__block", "-1"))
        extra = self.r.choice(("", "", "", " clearfix", " row", " u-mt-2"))
        return f'<{tag} {self.r.choice(("class", "class", "id"))}="{name}{extra}">'

    def link(self, text: str | None = None) -> str:
        return f'<a href="/{self.some(1, 1)}">{text or self.some(1, 3)}</a>'

    def links(self, low: int = 3, high: int = 9) -> str:
        n = self.r.randint(low, high)
        style = self.r.random()
        if style < 0.75:
            return self.open("ul", "menu list links items") + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        if style < 0.9:
            return self.r.choice((" | ", " ", " &middot; ", "\n")).join(self.link() for _ in range(n))
        return "".join(f"<p>{self.link()}</p>" for _ in range(n))

    # parts of the page that aren't the article

    def nav(self) -> str:
        tag = self.r.choice(("nav", "nav", "nav", "div", "ul"))
        if tag == "ul":
            return self.open("ul", "nav menu navigation topmenu", True) + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(3, 8))) + "</ul>"
        return self.open(tag, "nav menu navbar navigation breadcrumb breadcrumbs pagination toc", tag == "div") + self.links() + f"</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        inner = [self.r.choice((f"<p>{self.sentence(2, 8)}</p>", f"<div>{self.some(1, 4)}</div>", f"<h1>{self.some(1, 3)}</h1>", self.some(2, 6), f"<h2>{self.some(1, 4)}</h2>"))]
        if self.r.random() < 0.6:
            inner.append(self.nav())
        if self.r.random() < 0.2:
            inner.append(self.form())
        if self.r.random() < 0.3:
            inner.append(f"<p>{self.prose(1, 2)}</p>")
        return self.open(tag, "header masthead banner branding topbar logo", tag == "div") + "".join(inner) + f"</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "footer", "div"))
        inner = [self.r.choice(("&copy; ", "© ", "Copyright ")) + f"www.{self.some(1, 1)}.example.com &middot; " + self.prose(1, 2)]
        if self.r.random() < 0.5:
            inner.append(self.links(2, 6))
        if self.r.random() < 0.4:
            inner.append(f"<p>{self.prose(1, 3)}</p>")
        self.r.shuffle(inner)
        return self.open(tag, "footer copyright colophon bottom legal", tag == "div") + "".join(inner) + f"</{tag}>"

    def side(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        inner = []
        for _ in range(self.r.randint(1, 3)):
            inner.append(f"<h3>{self.some(1, 4)}</h3>" * self.r.randint(0, 1) + self.r.choice((self.links, lambda: f"<p>{self.prose(1, 3)}</p>", lambda: f"<p>{self.prose(2, 5)}</p><p>{self.prose(1, 3)}</p>", lambda: f"<div>{self.prose(1, 2)}</div>", lambda: f"<ul><li>{self.sentence()}</li><li>{self.sentence()}</li></ul>"))())
        return self.open(tag, "sidebar side aside widget widgets related recommended popular trending rail", tag != "aside") + "".join(inner) + f"</{tag}>"

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "div", "aside", "section", "p"))
        inner = self.r.choice((self.prose(1, 2), self.prose(1, 3), self.link(self.some(2, 6)), f"{self.prose(1, 1)} {self.link()}"))
        if tag != "p" and self.r.random() < 0.4:
            inner = f"<p>{inner}</p>"
        return self.open(tag, "ad ads advert advertisement sponsored sponsor promo adslot ad-banner", True) + inner + f"</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(("div", "div", "section", "dialog", "aside"))
        inner = f"<p>{self.prose(1, 3)}</p>" if self.r.random() < 0.6 else self.prose(1, 3)
        inner += f"<button>{self.some(1, 2)}</button>" * self.r.randint(0, 2)
        if self.r.random() < 0.2:
            return f'<div role="alert">{inner}</div>'
        return self.open(tag, "cookie cookies cookie-notice consent gdpr notice popup modal alert newsletter subscribe overlay paywall", tag != "dialog") + inner + f"</{tag}>"

    def form(self) -> str:
        inner = "".join(self.r.choice((f"<label>{self.some(1, 3)}<input name=q></label>", f"<p>{self.sentence(2, 9)}</p><input type=email>", f"<label>{self.some(1, 2)}</label> <input>", f"<textarea>{self.some(1, 4)}</textarea>", f"<select><option>{self.some(1, 1)}<option>{self.some(1, 1)}</select>", f"<fieldset><legend>{self.some(1, 3)}</legend><input></fieldset>")) for _ in range(self.r.randint(1, 3)))
        if self.r.random() < 0.5:
            inner = self.r.choice((f"<p>{self.prose(1, 2)}</p>", f"<h3>{self.some(1, 4)}</h3>", self.prose(1, 1))) + inner
        return self.open("form", "search searchform login signup contact subscribe") + inner + f"<button>{self.some(1, 2)}</button></form>"

    def comments(self) -> str:
        tag = self.r.choice(("section", "div", "div", "ol", "ul"))
        item = "li" if tag in ("ol", "ul") else self.r.choice(("div", "article", "p"))
        inner = []
        for _ in range(self.r.randint(1, 6)):
            body = self.prose(1, 4)
            if item != "p":
                body = self.r.choice((f"<p>{body}</p>", f"<b>{self.some(1, 2)}</b> {body}", f"<p>{self.some(1, 2)}</p><p>{body}</p>", body))
            inner.append(self.open(item, "comment reply comment-body response") + body + f"</{item}>")
        head = f"<h3>{self.some(1, 3)}</h3>" if item != "li" and self.r.random() < 0.5 else ""
        return self.open(tag, "comments comment-list discussion disqus replies respond reviews", True) + head + "".join(inner) + f"</{tag}>"

    def share(self) -> str:
        return self.open("div", "share sharing social social-share follow", True) + self.r.choice((self.links(2, 5), self.some(2, 6), " ".join(self.some(1, 1) for _ in range(4)))) + "</div>"

    # the article

    def marked(self, text: str) -> str:
        return _MARK + text

    def inline(self) -> str:
        text = self.prose()
        if self.r.random() < 0.25:
            text += " " + self.r.choice((self.link(), f"<b>{self.some(1, 3)}</b>", f"<em>{self.some(1, 4)}</em>", "<code>a &lt; b</code>")) + " " + self.sentence()
        if self.r.random() < 0.1:
            text = f"<b>{text}<br>"
        return escape(text, quote=False).replace("&lt;", "<").replace("&gt;", ">") if self.r.random() < 0.02 else text

    def block(self) -> str:
        x = self.r.random()
        if x < 0.68:
            return f"<p>{self.marked(self.inline())}" + ("</p>" if self.r.random() < 0.9 else "")
        if x < 0.78:
            return f"<h{self.r.randint(2, 4)}>".join(("", self.marked(self.some(1, 7)))) + f"</h{2}>"
        if x < 0.86:
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.marked(self.sentence(2, 14) if self.r.random() < 0.8 else self.link(self.some(1, 4)))}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if x < 0.91:
            return f"<blockquote>{self.marked(self.prose(1, 3))}</blockquote>" if self.r.random() < 0.5 else f"<blockquote><p>{self.marked(self.prose(1, 3))}</p></blockquote>"
        if x < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.marked(self.some(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 4))) + "</table>"
        if x < 0.97:
            return f"<figure><img src=x><figcaption>{self.marked(self.sentence(3, 12))}</figcaption></figure>"
        return f"<div>{self.marked(self.prose(1, 4))}</div>" if self.r.random() < 0.7 else f"<pre>{self.marked(self.some(3, 15))}</pre>"

    def article(self) -> str:
        style = self.r.random()
        body = [self.block() for _ in range(self.r.choice((1, 1, 2, 3, 4, 5, 6, 8, 10, 14, 25)))]
        if self.r.random() < 0.15:
            body = [f"<p>{self.marked(self.r.choice((self.some(1, 4), self.sentence(1, 5))))}</p>" for _ in range(self.r.randint(1, 4))]
        if self.r.random() < 0.2:
            body.insert(self.r.randint(0, len(body)), self.advert())
        if self.r.random() < 0.08:
            body.insert(self.r.randint(0, len(body)), self.r.choice((self.side, self.share, self.notice, self.form))())
        if self.r.random() < 0.85:
            title = f"<h1>{self.marked(self.some(1, 12))}</h1>"
            body.insert(0, f"<header>{title}</header>" if self.r.random() < 0.15 else title)
        inner = "".join(body)
        if self.r.random() < 0.15:
            inner = self.open("div", "content body entry-content text article-body") + inner + "</div>"
        if style < 0.55:
            return self.open("article", "post article entry story") + inner + "</article>"
        if style < 0.7:
            return self.open("main", "main content") + inner + "</main>"
        if style < 0.95:
            return self.open("div", "content post article entry story main post-content article-body", True) + inner + "</div>"
        return self.open("section", "content article main") + inner + "</section>"

    def page(self) -> str:
        r, before, after = self.r, [], []
        for chance, part, places in ((0.6, self.header, (before,)), (0.75, self.nav, (before,)), (0.35, self.advert, (before, after)), (0.25, self.notice, (before, before, after)), (0.2, self.form, (before, after)), (0.4, self.side, (before, after, after)), (0.35, self.comments, (after,)), (0.2, self.share, (before, after)), (0.15, self.advert, (after,))):
            if r.random() < chance:
                r.choice(places).append(part())
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(self.footer())
        middle = self.article() if r.random() > 0.02 else ""
        if r.random() < 0.3:
            inside = [x for x in (before[-1:] if r.random() < 0.3 else []) if "<aside" in x]
            middle = self.open(r.choice(("div", "main")), "main content container wrapper page") + "".join(inside) + middle + ("".join(after[:1]) if r.random() < 0.4 else "") + "</div></main>"
        html = f"<!DOCTYPE html><html><head><title>{self.some(2, 6)}</title><style>p{{margin:0}}</style></head><body>" + r.choice(("", "\n", "<!-- x -->")).join([*before, middle, *after]) + "</body></html>"
        return html if r.random() > 0.08 else html[: int(len(html) * r.uniform(0.6, 1))]


def sample_page(rng: random.Random) -> tuple[Page, np.ndarray]:
    """A random page and for each node whether it holds a part of the article."""
    page = Page(_Writer(rng).page())
    label = np.zeros(len(page.kind))
    for i in range(len(label) - 1, 0, -1):
        text = page.text[i]
        if text is not None and _MARK in text:
            label[i], page.text[i] = 1, text.replace(_MARK, "").strip() or "x"
        if label[i]:
            label[page.parent[i]] = 1
    return page, label


@lru_cache(maxsize=2)
def fitted(pages: int = PAGES, seed: int = SEED) -> BoostedTrees:
    """Trees fitted to written pages; the same for the same parameters."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        page, label = sample_page(rng)
        x.append(page.features()[1:])
        y.append(label[1:])
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y))


def extract(html: str | None, model: BoostedTrees) -> str:
    page = Page(html)
    return "\n".join(page.decode(model.predict(page.features())))


def extracted(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",), model: BoostedTrees | None = None) -> DataFrame:
    """Per page its key, the columns to keep, ``text`` and ``n_chars`` (code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fitted())
    source = pages.select(f"`{key}`", *[f"`{c}`" for c in keep], f"`{html}`")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    names = [*source.columns[:-1], "text", "n_chars"]

    def run(batches):
        trees = shared.value
        for batch in batches:
            texts, waiting, held = [], [], 0

            def judge() -> None:
                nonlocal waiting, held
                if waiting:
                    p = trees.predict(np.concatenate([f for _, f in waiting]))
                    at = 0
                    for page, f in waiting:
                        texts.append("\n".join(page.decode(p[at : at + len(f)])))
                        at += len(f)
                waiting, held = [], 0

            for x in batch.column(len(names) - 2):
                page = Page(x.as_py())
                waiting.append((page, page.features()))
                held += len(page.kind)
                if held > 20_000:
                    judge()
            judge()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return source.mapInArrow(run, f"{fields}, text string, n_chars bigint")

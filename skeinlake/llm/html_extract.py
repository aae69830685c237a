"""Main text of web pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only
from .html_blocks import FEATURES, blocks

_MARK = "\ue000"


class _Writer:
    """Random pieces of web pages; a block of the article has the mark at its front."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.pick, self.chance = self.r.choice, lambda p: self.r.random() < p

    def word(self) -> str:
        return "".join(self.pick("aeiou" if i % 2 else "bcdfglmnprst") for i in range(self.r.randint(2, 9)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        return self.words(3, 18).capitalize() + self.pick("....?!")

    def para(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def link(self, a: int = 1, b: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(a, b)}</a>'

    def links(self) -> str:
        return "<ul>" + "".join(f"<li>{self.link(1, 6)}</li>" for _ in range(self.r.randint(2, 8))) + "</ul>"

    def some(self, *makers, least: int = 1, most: int = 4) -> str:
        return "".join(self.pick(makers)() for _ in range(self.r.randint(least, most)))

    def named(self, *names: str) -> str:
        return f'{self.pick(("class", "class", "id"))}="{self.pick(names)}"'

    def neutral(self) -> str:
        """A name that says nothing, or none."""
        said = self.pick(("top", "col1", "col2", "left", "right", "bot", "c1", "box", "wrap", "row", "panel", "inner", "upper", "lower", self.word(), self.word()))
        return self.pick(("", f' class="{said}"', f' id="{said}"', f' id="{said}"'))

    # ---- what is not the article
    def nav(self) -> str:
        return self.pick([
            lambda: f"<nav>{self.links()}</nav>", lambda: f"<nav>{self.words(1, 12)}</nav>", lambda: f"<nav><p>{self.sentence()}</p></nav>",
            lambda: f'<div {self.named("menu", "main-nav", "navbar", "breadcrumb", "top-menu", "nav_main")}>{self.links()}</div>',
            lambda: f'<div role="navigation">{self.link()} | {self.link()} | {self.link()}</div>',
            lambda: f'<ul id="menu"><li>{self.link()}<li>{self.link()}<li>{self.link()}</ul>',
        ])()

    def header(self) -> str:
        return self.pick([
            lambda: f"<header>{self.words(1, 9)}</header>", lambda: f"<header>{self.links()}</header>",
            lambda: f"<header><h1>{self.words(1, 3)}</h1><p>{self.words(3, 8)}</p></header>",
            lambda: f"<header><a href=/>{self.words(1, 3)}</a>{self.nav()}</header>",
            lambda: f'<div id="header"><a href="/">{self.words(1, 2)}</a><p>{self.sentence()}</p></div>',
            lambda: f'<div {self.named("masthead", "site-header", "page-header", "branding")}><div>{self.words(1, 4)}</div>{self.pick(("", self.nav()))}</div>',
        ])()

    def footer(self) -> str:
        return self.pick([
            lambda: f"<footer>{self.words(1, 9)}</footer>", lambda: f"<footer>&copy; {self.word()} &middot; {self.sentence()}</footer>",
            lambda: f"<footer><p>{self.sentence()}</p>{self.links()}</footer>", lambda: f"<footer><div>{self.para(4)}</div></footer>",
            lambda: f'<div class="footer"><p>&copy; 2024 {self.words(1, 3)}. All rights reserved.</p></div>',
            lambda: f'<div id="site-footer"><p>{self.para(3)}</p></div>', lambda: f'<div {self.named("copyright", "legal", "colophon")}>{self.para(2)}</div>',
        ])()

    def aside(self) -> str:
        return self.pick([
            lambda: f"<aside><h3>{self.words(1, 3)}</h3>{self.links()}</aside>", lambda: f"<aside><p>{self.para(4)}</p></aside>", lambda: f"<aside>{self.sentence()}</aside>",
            lambda: f'<div {self.named("sidebar", "right-rail", "widget")}><h2>{self.words(1, 3)}</h2><p>{self.para(4)}</p></div>',
            lambda: f'<div {self.named("related", "recommended", "trending")}><h3>{self.words(1, 3)}</h3>{self.links()}</div>',
            lambda: f'<section class="related-posts">{self.some(lambda: f"<article><h4>{self.link(2, 6)}</h4><p>{self.sentence()}</p></article>", lambda: f"<p>{self.sentence()}</p>")}</section>',
            lambda: f'<div class="sidebar-content"><div class="post"><p>{self.para(2)}</p></div></div>',
        ])()

    def advert(self) -> str:
        return self.pick([
            lambda: f'<div class="ad">{self.para(4)}</div>', lambda: f'<div id="banner">{self.link()}</div>', lambda: f"<div class=ad-box>{self.sentence()}</div>",
            lambda: f'<div class="{self.pick(("ads", "advertisement", "ad-slot", "sponsored", "promo-box", "sponsored-content"))}"><p>{self.para(3)}</p></div>',
        ])()

    def notice(self) -> str:
        return self.pick([
            lambda: f'<div {self.named("cookie-banner", "cookie-notice", "consent", "newsletter", "notice", "alert", "paywall")}><p>{self.para(3)}</p><button>{self.words(1, 2)}</button></div>',
            lambda: f'<div id="cookies">{self.sentence()} {self.link()}</div>', lambda: f'<div role="{self.pick(("dialog", "alert"))}"><p>{self.sentence()}</p></div>',
            lambda: f"<dialog><p>{self.para(2)}</p></dialog>", self.unseen,
        ])()

    def unseen(self) -> str:
        return f"<{(k := self.pick(('div', 'section', 'p')))} {self.pick(('hidden', 'style=display:none', 'aria-hidden=true'))}>{self.para(3)}</{k}>"

    def form(self) -> str:
        return self.pick([
            lambda: f'<form action="/x"><label>{self.words(1, 3)}</label><input name="q"><button>{self.word()}</button></form>',
            lambda: f'<form class="search"><p>{self.sentence()}</p><input><select><option>{self.word()}</select></form>',
            lambda: f'<div class="login-form"><form><p>{self.para(2)}</p><textarea>x</textarea></form></div>',
            lambda: f"<form><h3>{self.words(1, 4)}</h3><p>{self.para(2)}</p><input><button>{self.words(1, 2)}</button></form>",
        ])()

    def comments(self) -> str:
        one = (
            lambda: f'<div class="comment"><b>{self.word()}</b><p>{self.para(5)}</p></div>', lambda: f"<li><p>{self.para(4)}</p></li>", lambda: f"<p>{self.para(3)}</p>",
            lambda: f"<article><h4>{self.word()}</h4><p>{self.para(3)}</p></article>", lambda: f'<div class="comment-content"><p>{self.para(4)}</p></div>',
            lambda: f"<article><header>{self.words(1, 3)}</header><p>{self.para(3)}</p><footer>{self.link()}</footer></article>",
        )
        inner, head = self.some(*one), self.pick(("", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 3)}</h2>"))
        return self.pick([
            lambda: f"<section {self.named('comments', 'comments-area')}>{head}{inner}</section>", lambda: f'<div {self.named("comments", "reader-comments", "disqus_thread")}>{head}{inner}</div>',
            lambda: f'{head and head.replace(">", " class=comments-title>", 1)}<ol class="comment-list">{inner}</ol>', lambda: f'<div id="respond">{head}{inner}{self.form()}</div>',
        ])()

    def byline(self) -> str:
        text = self.pick((f"{self.words(2, 4).title()}", f"By {self.words(2, 2).title()}, {self.r.randint(1, 28)} {self.word()} 2024", f"{self.link()} &middot; <time>2024-01-{self.r.randint(10, 28)}</time>"))
        tag = self.pick(("p", "div", "p", "address"))
        return f"<{tag} {self.named('byline', 'meta', 'post-meta', 'entry-meta', 'meta-content', 'author', 'article-date', 'author-info')}>{text}</{tag}>"

    def share(self) -> str:
        return self.pick([
            lambda: f'<div class="share">{self.link()} {self.link()}</div>', lambda: f'<div class="social-links">{self.words(1, 4)}</div>', lambda: f'<ul class="tags"><li>{self.link()}<li>{self.link()}</ul>',
            lambda: f'<div class="author-bio"><h4>{self.words(2, 3)}</h4><p>{self.para(3)}</p></div>', self.byline, lambda: f'<p class="tags">{self.link()}, {self.link()}</p>',
        ])()

    def line(self) -> str:
        """A line between the paragraphs that is none of them."""
        name = self.pick((self.neutral(), ' class="entry-utility"', ' class="post-info"'))
        return f"<div{name}>{self.words(1, 4).capitalize()}{self.pick(('', '', ' ' + self.link(1, 1)))}</div>"

    def leading_on(self) -> str:
        """The end of an article: links to others under a short line."""
        head = self.pick(("<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>", "<p><b>{}</b></p>", "<p>{}</p>", "<div>{}</div>")).format(self.words(1, 3).capitalize())
        return head + self.links()

    def unnamed_page(self) -> str:
        """The body of a page whose names say nothing: place, size and links tell the article."""
        site, cell = self.words(1, 3).title(), self.chance(0.25)
        top = self.pick((site, f'<a href="/">{site}</a>', f"<h1>{site}</h1><p>{self.words(3, 8)}</p>", f"<h1>{site}</h1>", f"<p>{site}</p>"))
        menu = self.pick((self.links(), self.pick((" ", " | ", "<br>")).join(self.link(1, 2) for _ in range(self.r.randint(2, 7)))))
        side = self.pick((f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<h3>{self.words(1, 3)}</h3><p>{self.sentence()}</p>", f"<h2>{self.words(1, 2)}</h2>{self.link()} {self.link()}"))
        foot = self.pick((f"{site}, {self.words(2, 7)}", f"<p>{self.words(2, 9)}</p>", f"&copy; {site}", f"<p>{self.sentence()}</p>{self.link()} {self.link()}", f"{site} {self.words(1, 3)} {self.r.randint(1950, 2024)}"))
        text = "".join(f"<p>{_MARK}{self.para(6)} {self.sentence()}</p>" + (self.block() if self.chance(0.5) else "") for _ in range(self.r.randint(2, 5)))
        head = f"<h{(k := self.pick('112'))}>{_MARK}{self.words(1, 7).capitalize()}</h{k}>" if self.chance(0.8) else ""
        main = head + (self.line() if head and self.chance(0.2) else "") + text + (self.leading_on() if self.chance(0.15) else "")
        if cell:
            row = f"<td>{menu}</td><td>{main}</td>" + (f"<td>{side}</td>" if self.chance(0.3) else "")
            return f"<table><tr><td colspan=2>{top}</td></tr><tr>{row}</tr><tr><td colspan=2>{foot}</td></tr></table>"
        held = [f"<div{self.neutral()}>{x}</div>" for x in (top, menu, main, side, foot)]
        if self.chance(0.2):
            held[2] = f"<div{self.neutral()}>{held[2]}</div>"
        if self.chance(0.5):
            del held[3]
        elif self.chance(0.5):
            held[2], held[3] = held[3], held[2]
        if self.chance(0.3):
            del held[self.pick((0, 1))]
        inner = "".join(held)
        return f"<div{self.neutral()}>{inner}</div>" if self.chance(0.4) else inner

    # ---- the article
    def block(self) -> str:
        x = self.r.random()
        if x < 0.55:
            text = self.para(9) if self.chance(0.6) else self.sentence() if self.chance(0.6) else self.words(1, 60)
            return f"<p{self.pick(('', '', '', ' class=lead', ' class=text', ' class=intro'))}>{_MARK}{text}" + self.pick(("</p>", "</p>", "</p>", ""))
        return self.pick([
            lambda: f"<p>{_MARK}{self.sentence()} {self.link()} {self.para(3)}</p>", lambda: f"<p><b>{_MARK}{self.words(1, 9)}<br>", lambda: f"<div>{_MARK}{self.para(5)}</div>",
            lambda: (lambda k: f"<h{k}>{_MARK}{self.words(1, 7)}</h{k}>")(self.pick("234")), lambda: f"<h{self.pick('2234')}>{_MARK}{self.words(1, 7)}</h2>",
            lambda: self.pick(("<ul>", "<ol>")) + self.some(lambda: f"<li>{_MARK}{self.words(2, 14)}</li>", least=2, most=6) + "</ul></ol>",
            lambda: f"<p>{_MARK}{self.words(3, 14).capitalize()}:</p><ul>" + self.some(lambda: f"<li>{_MARK}{self.link(1, 6)}{self.pick(('', ' ' + self.words(2, 9)))}</li>", most=5) + "</ul>",
            lambda: f"<blockquote><p>{_MARK}{self.para(3)}</p></blockquote>", lambda: f"<pre>{_MARK}{self.words(3, 20)}</pre>", lambda: f"<dl><dt>{_MARK}{self.word()}<dd>{_MARK}{self.sentence()}</dl>",
            lambda: "<table>" + self.some(lambda: f"<tr><td>{_MARK}{self.words(1, 4)}</td><td>{_MARK}{self.words(1, 4)}</td></tr>") + "</table>",
            lambda: f"<figure><img src=x><figcaption>{_MARK}{self.words(2, 9)}{self.pick('. ')}</figcaption></figure>",
            lambda: f"<section><h2>{_MARK}{self.words(1, 5)}</h2><p>{_MARK}{self.para(5)}</p></section>",
        ])()

    def interruption(self) -> str:
        return self.pick((self.advert, self.aside, self.aside, self.share, self.notice, self.form, self.nav, self.unseen, self.line))()

    def title(self) -> str:
        h1 = f"<h1{self.pick(('', '', ' class=entry-title', ' class=page-title'))}>{_MARK}{self.words(1, 9).capitalize()}{self.pick(('', '', '.', '?'))}</h1>"
        if self.chance(0.35):
            lead = f"<p class={self.pick(('lead', 'subtitle', 'standfirst'))}>{_MARK}{self.sentence()}</p>" if self.chance(0.3) else ""
            by = self.byline() if self.chance(0.5) else ""
            return self.pick((f"<header>{h1}{lead}{by}</header>", f'<div class="{self.pick(("entry-header", "post-header", "article-head"))}">{h1}{by}{lead}</div>'))
        return h1 + (self.byline() if self.chance(0.25) else "")

    def article(self) -> str:
        out = [] if self.chance(0.2) else [self.title()]
        for _ in range(self.pick((1, 1, 2, 3, 4, 5, 7, 9))):
            out.append(self.block())
            if self.chance(0.08):
                out.append(self.interruption())
        if self.chance(0.3):
            # something beside the article, then its last paragraph
            out += [self.interruption(), f"<p>{_MARK}{self.para(4)}</p>"]
        if self.chance(0.12):
            out += [f"<p>{_MARK}{self.para(4)}</p>", self.leading_on()]
        return "".join(out)

    def container(self, inner: str) -> str:
        """The article in what holds it; an article element may hold comments and a footer too."""
        odd = f'{self.word()} {self.pick(("popular-content", "social-story", "legal", "more-news", "contact", "search-page", "has-sidebar", "with-comments", "comment-enabled", ""))}'
        tail = self.pick((self.comments, self.share, self.advert, lambda: f"<footer><p>{self.words(1, 9)}</p>{self.pick(('', self.links()))}</footer>"))() if self.chance(0.3) else ""
        held = self.pick((lambda: inner, lambda: f'<div class="{self.pick(("entry-content", "article-body", "text", self.word()))}">{inner}</div>'))()
        return self.pick([
            lambda: f"<article>{held}{tail}</article>", lambda: f"<article>{inner}</article>", lambda: f"<article class='{odd}'>{inner}</article>{tail}", lambda: f"<main class='{odd}'>{held}</main>",
            lambda: f"<main><article>{held}{tail}</article></main>", lambda: f"<main>{held}{tail}</main>", lambda: f'<div role="main">{held}</div>',
            lambda: f'<div {self.named("content", "post-content", "entry", "article-body", "story", "post", "main-content", "main")}>{inner}</div>{tail}',
            lambda: f'<div id="main"><div class="{self.word()}">{inner}</div>{tail}</div>', lambda: f"<div>{inner}</div>", lambda: inner, lambda: f"<section>{inner}</section>",
            lambda: f'<div class="{self.word()}">{inner}</div>', lambda: f'<table><tr><td class="menu">{self.links()}</td><td class="content">{inner}</td></tr></table>',
        ])()

    def page(self, i: int) -> str:
        content = self.container(self.article())
        before = [f() for f in (self.nav, self.header, self.advert, self.notice, self.aside, self.form, self.share) if self.chance(0.35)]
        after = [f() for f in (self.comments, self.aside, self.advert, self.share, self.form, self.notice, self.nav) if self.chance(0.3)]
        self.r.shuffle(before)
        foot = self.footer() if self.chance(0.8) else ""
        if i % 8 == 5:  # nothing but the article
            before, after, foot = [], [], ""
        if i % 24 == 5:
            content = f"<article><p>{_MARK}{self.words(1, 80)}</article>"
        if i % 12 == 7:  # one short paragraph between menu and footer
            content, before, after = f"<{(k := self.pick(('article', 'main')))}><p>{_MARK}{self.words(1, 5).capitalize()}.</p></{k}>", [self.nav()], []
        inner = "".join(before) + content + "".join(after) + foot
        if self.chance(0.3):
            open_ = self.pick((f'<div id="{self.pick(("page", "wrapper", "container", "main-wrapper"))}">', '<div class="layout has-sidebar">', "<form id=aspnetForm method=post>", '<div class="row">'))
            inner = f"{open_}{inner}</{open_[1:].split()[0]}>"
        if i % 6 == 2:
            inner = self.unnamed_page()
        body = self.pick(("<body>", "<body>", "<body class='page with-sidebar no-comments'>"))
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><script>var a='<p>';</script></head>{body}{inner}" + self.pick(("</body></html>", ""))


def labelled_pages(n: int = 900, seed: int = 5) -> list[str]:
    """Training pages, made here: layouts of many kinds, the text of the article marked by a
    private character at the front of each of its blocks."""
    w = _Writer(seed)
    return [w.page(i) for i in range(n)]


class Chain:
    """A two-label linear chain: weights of the features for label 1 and of the four steps."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray) -> None:
        self.weights, self.steps = weights, steps
        self._w, self._s = weights.tolist(), steps.tolist()

    def decode(self, features: list[list[int]]) -> list[int]:
        """The most likely labels (Viterbi); of equals label 0."""
        if not features:
            return []
        w, ((t00, t01), (t10, t11)) = self._w, self._s
        a, b, back = 0.0, sum([w[f] for f in features[0]]), []
        for x in features[1:]:
            e = sum([w[f] for f in x])
            from0, from1 = (a + t00, a + t01), (b + t10, b + t11)
            p, q = int(from1[0] > from0[0]), int(from1[1] > from0[1])
            back.append((p, q))
            a, b = max(from0[0], from1[0]), max(from0[1], from1[1]) + e
        label = [int(b > a)]
        for pq in reversed(back):
            label.append(pq[label[-1]])
        return label[::-1]


def gradient(w: np.ndarray, s: np.ndarray, x: np.ndarray, y: np.ndarray, at: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the labels y and its gradient by the weights w and the steps s.

    x, y: features and label of every block; at: for each place the rows of the blocks that stand
    there, pages in one order with the longest first, so that a place's pages are the first of the
    place before. Forward and backward sums over all pages at once."""
    e = np.zeros((len(y), 2))
    e[:, 1] = x @ w
    fw, bw = e.copy(), np.zeros_like(e)
    for before, here in zip(at, at[1:]):
        fw[here] += np.logaddexp(fw[before[: len(here)], :1] + s[0], fw[before[: len(here)], 1:] + s[1])
    for before, here in zip(reversed(at[:-1]), reversed(at[1:])):
        after = e[here] + bw[here]
        bw[before[: len(here)]] = np.logaddexp(s[:, 0] + after[:, :1], s[:, 1] + after[:, 1:])
    z = np.zeros(len(y))
    z[at[0]] = np.logaddexp(*(fw[at[0]] + bw[at[0]]).T)
    for before, here in zip(at, at[1:]):
        z[here] = z[before[: len(here)]]
    gs, total = np.zeros((2, 2)), float((e[np.arange(len(y)), y]).sum() - z[at[0]].sum())
    for before, here in zip(at, at[1:]):
        b = before[: len(here)]
        pair = np.exp(fw[b][:, :, None] + s + (e[here] + bw[here])[:, None, :] - z[here, None, None])
        np.add.at(gs, (y[b], y[here]), 1)
        gs -= pair.sum(0)
        total += float(s[y[b], y[here]].sum())
    return total, (y - np.exp(fw[:, 1] + bw[:, 1] - z)) @ x, gs


def examples(pages: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What gradient() takes, of marked pages."""
    found = []
    for p in pages:
        label = [int(_MARK in b.text) for b in blocks(p)]
        if label:
            found.append(([b.features for b in blocks(p.replace(_MARK, ""))], label))
    found.sort(key=lambda f: -len(f[1]))
    x = np.zeros((sum(len(y) for _, y in found), len(FEATURES)))
    starts = np.cumsum([0, *(len(y) for _, y in found)])[:-1]
    for i, f in enumerate(f for fs, _ in found for f in fs):
        x[i, f] = 1
    size = np.array([len(y) for _, y in found])
    return x, np.concatenate([y for _, y in found]), [starts[size > t] + t for t in range(int(size.max()))]


def train(pages: list[str], rounds: int = 160, ridge: float = 0.002) -> Chain:
    """Maximum likelihood with a ridge, by Adam."""
    x, y, at = examples(pages)
    n = len(at[0])
    w, s = np.zeros(len(FEATURES)), np.zeros((2, 2))
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w, s)]
    for step in range(1, rounds + 1):
        _, *gradients = gradient(w, s, x, y, at)
        for (p, m, v), g in zip(state, gradients):
            g = g / n - ridge * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(w, s)


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return train(labelled_pages())


def main_text(page: str | None, chain: Chain, seen: dict | None = None) -> str:
    found = blocks(page, seen) if page else []
    return "\n\n".join(b.text for b, keep in zip(found, chain.decode([b.features for b in found])) if keep)


def extract_main_text(pages: DataFrame, chain: Chain | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    text: the leaf blocks that the chain labels as article, in page order, joined by two line ends;
    character references decoded, white space inside a block one space. Null, empty or blank html
    and pages without an article: the empty text. Nothing is cut however long the page. Formulas
    (math) are text of their sentence; drawings (svg), players, templates, choice lists, scripts and
    styles are no text of the page. Where no name and no element tells the article, the part with the
    bulk of the text that is no link does; links that end an article under a short line, and short
    lines that stand in a div of their own after others, are not article. A byline is not article, a heading in the article's header is. Repeated
    rows are all kept, null ids and addresses pass through, extra columns are ignored; an empty
    table gives an empty one. The chain (by default trained on labelled_pages()) goes to the
    workers: about a hundred numbers.
    """
    chain = chain or default_chain()

    def rows(batches):
        seen: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                text = [main_text(h.as_py(), chain, seen) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    out = only(pages, page_id, url, html).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return out.mapInArrow(rows, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
